"""Personal data by weak supervision (native).

Spans of the base kinds (email, ip, card, phone) are found by their patterns and checks and
always stay.  Candidates of further kinds (secret, ssn, tel) come from wider patterns.  Five
labelers vote on every match of a pattern, 1, -1 or 0 for none: a strict form of its kind, a
check (octets, Luhn, digits, areas, mixed characters), a gazetteer of cue words before it, its
context (what stands on either side) and its shape.  Matches of base kinds that fail their check
vote as well: they are the natural negatives, and never become spans.  The counts of vote
patterns, at most 7 * 3**5 * 2 whatever the corpus, go to the driver; expectation-maximisation
estimates each labeler's reliability and each pattern's posterior; a logistic classifier is
trained on those, and its weights become a SQL expression that decides on each candidate.

A candidate that overlaps a base span is dropped.  Of added spans that overlap, the one that
starts first stays (of equal starts the longer); one that starts inside an earlier one is dropped.

A pattern is located by cutting the text at its matches: the lengths of the parts and of the
matches, summed by doubling steps, give the places in code points.  Patterns are possessive
and begin at the start of a run, and all sums over spans take n log n steps, so neither long texts
nor many matches in one text make it slow; matches are those of the plain patterns.

Defined cases: a null or empty text has no spans.  Repeated rows each give a row.  Without any
span there is no classifier and nothing is added.  Further columns are dropped (``redact``
keeps all columns).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .shared import stored

#: kind: pattern, condition on the text without which it can't match.  Base kinds first, in the order in which equal starts are listed.
BASE = ("email", "ip", "card", "phone")
KINDS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(text, '@')"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "digits and contains(text, '.')"),
    "card": (r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++", "digits"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "digits and contains(text, '+')"),
    "secret": (r"""(?i)(?<![a-z0-9])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)["']?\s{0,4}[=:]\s{0,4}["']?[a-z0-9_./+~-]{6,}+""", "contains(text, '=') or contains(text, ':')"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "digits and contains(text, '-')"),
    "tel": (r"(?<![0-9.+-])(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])", "digits"),
}
#: What stands before the value in a secret's match.
SECRET_KEY = r"""(?i)^[a-z_-]+["']?\s*[=:]\s*["']?"""
#: Gazetteer (fixed values): cue words of each kind, and words that speak against personal data.
CUES = {
    "email": "mail email e-mail contact address write reach send",
    "ip": "ip host server address login from client",
    "card": "card visa mastercard amex credit debit payment pay",
    "phone": "phone tel call mobile cell fax whatsapp sms contact",
    "secret": "password passwd pwd secret token key credential login",
    "ssn": "ssn social security taxpayer insurance",
    "tel": "phone tel call mobile cell fax dial number contact",
}
AGAINST = "version release section page chapter isbn issn figure table build rev order invoice item ref"
#: Strict forms of the kinds.
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$",
    "ip": r"^(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}$",
    "card": r"^[3-6][0-9]{3}([ -]?)[0-9]{4,6}\1[0-9]{4,5}(\1[0-9]{1,7})?$",
    "phone": r"^\+[1-9][0-9]{0,2}([ .-]?[(]?[0-9]{1,5}[)]?){2,5}$",
    "secret": r"^(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z]).{8,}$",
    "ssn": r"^(?!123-45-6789)(?!([0-9])\1\1-)",
    "tel": r"^([(][0-9]{3}[)] ?[0-9]{3}-[0-9]{4}|[0-9]{3}([ .-])[0-9]{3}\2[0-9]{4})$",
}
LABELERS = ("v_form", "v_check", "v_cue", "v_context", "v_shape")
LUHN = (
    "length(d) between 12 and 19 and aggregate(sequence(1, length(d)), 0, (a, i) -> a + if(i % 2 = 1, int(substr(reverse(d), i, 1)), "
    "int(substr('0246813579', int(substr(reverse(d), i, 1)) + 1, 1)))) % 10 = 0"
)


def _check(kind: str) -> str:
    """SQL on m: the check of a base kind, or what passes for one with a candidate."""
    digits = "regexp_replace(m, '[^0-9]', '')"
    return {
        "email": "true",
        "ip": "forall(split(m, '[.]'), x -> coalesce(try_cast(concat('0', ltrim('0', x)) as int) <= 255, false))",
        "card": LUHN.replace("(d)", f"({digits})"),
        "phone": f"length({digits}) between 9 and 15",
        "secret": "2 * size(array_distinct(split(left(m, 64), ''))) >= length(left(m, 64))",
        "ssn": "not (m rlike '^(000|666|9)' or m rlike '-00-|-0000$')",
        "tel": "not m rlike '^[(]?[01]'",
    }[kind]


def _running(a: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running values of op over an array, in doubling steps: after each, a value covers twice as many places."""
    steps = F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.greatest(F.size(a), F.lit(1)))).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.aggregate(steps, a, lambda done, step: F.transform(done, lambda x, j: F.when(j >= step, op(x, F.get(done, j - step))).otherwise(x)))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _located(kind: str) -> Column:
    """The matches of a pattern, in order, with their places, what stands on either side and the check."""
    m, p = F.col(f"m_{kind}"), F.col(f"p_{kind}")
    ends = _running(F.transform(m, lambda x, j: F.length(x) + F.length(F.get(p, j))), lambda x, y: x + y)

    def one(ends: Column, x: Column, j: Column) -> Column:
        e, before, after = F.get(ends, j), F.right(F.get(p, j), F.lit(24)), F.left(F.get(p, j + 1), F.lit(8))
        return F.struct((e - F.length(x)).alias("s"), e.alias("e"), F.lit(kind).alias("kind"), x.alias("m"), before.alias("before"), after.alias("after"))

    return _let(ends, lambda ends: F.transform(m, lambda x, j: one(ends, x, j)))


def _apart(base: Column, more: Column) -> Column:
    """Those of more that overlap none of base (arrays of struct(x, ok))."""

    def kept(all_: Column) -> Column:
        upto = _running(F.transform(all_, lambda y: F.when(y["added"] == 0, y["e"]).otherwise(0)), F.greatest)
        onward = F.reverse(_running(F.reverse(F.transform(all_, lambda y: F.when(y["added"] == 0, y["s"]).otherwise(2**31 - 1))), F.least))
        free = lambda upto, onward: F.filter(all_, lambda y, j: (y["added"] == 1) & (F.get(upto, j) <= y["s"]) & (F.get(onward, j) >= y["e"]))
        return F.transform(_let(upto, lambda u: _let(onward, lambda o: free(u, o))), lambda y: y["y"])

    flat = lambda added: lambda y: F.struct(y["x"]["s"].alias("s"), F.lit(added).alias("added"), y["x"]["e"].alias("e"), y.alias("y"))
    both = F.array_sort(F.concat(F.transform(base, flat(0)), F.transform(more, flat(1))))
    return F.when((F.size(base) == 0) | (F.size(more) == 0), more).otherwise(_let(both, kept))


def spans(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns of keep, text, base, more (candidates) and failed (matches of base kinds that fail their
    check): arrays of struct(s, e, kind, votes, long)."""
    df = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text")).withColumn("digits", F.col("text").rlike("[0-9]"))
    none = F.array().cast("array<string>")
    for kind, (pattern, guard) in KINDS.items():
        m = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        df = df.withColumn(f"m_{kind}", F.when(F.expr(guard), m).otherwise(none))
    for kind, (pattern, _) in KINDS.items():
        parts = F.when(F.size(f"m_{kind}") > 0, F.split("text", pattern)).otherwise(none)
        df = df.withColumn(f"p_{kind}", parts)
    for kind in KINDS:
        got = _located(kind)
        got = F.transform(got, _without_key) if kind == "secret" else got
        df = df.withColumn(f"c_{kind}", F.when(F.size(f"m_{kind}") > 0, got).otherwise(F.array().cast("array<struct<s:int,e:int,kind:string,m:string,before:string,after:string>>")))
    for kind in KINDS:
        df = df.withColumn(f"c_{kind}", F.expr(f"transform(c_{kind}, x -> named_struct('x', x, 'ok', transform(array(x.m), m -> {_check(kind)})[0]))"))
    df = df.withColumn("base", F.concat(*[F.expr(f"filter(c_{k}, y -> y.ok)") for k in BASE]))
    df = df.withColumn("failed", F.concat(*[F.expr(f"filter(c_{k}, y -> not y.ok)") for k in BASE if k != "email"]))
    df = df.withColumn("more", F.concat(*[F.col(f"c_{k}") for k in KINDS if k not in BASE]))
    df = df.withColumn("more", _apart(F.col("base"), F.col("more")))
    return df.select(*keep, "text", *[F.transform(c, _voted).alias(c) for c in ("base", "more", "failed")])


def _without_key(x: Column) -> Column:
    key = F.length(F.regexp_extract(x["m"], SECRET_KEY, 0))
    return F.struct(
        (x["s"] + key).alias("s"), x["e"].alias("e"), x["kind"].alias("kind"), F.substring(x["m"], key + 1, F.length(x["m"])).alias("m"),
        F.right(F.concat(x["before"], F.substring(x["m"], F.lit(1), key)), F.lit(24)).alias("before"), x["after"].alias("after"),
    )


def _any(words: str) -> str:
    return r"(?i)(?<![a-z])(" + "|".join(words.split()) + r")(?![a-z])"


def _by_kind(kind: Column, of: dict[str, Column]) -> Column:
    out = F.lit(False)
    for k, v in of.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def _voted(y: Column) -> Column:
    x, ok = y["x"], y["ok"]
    m, before, after, kind = x["m"], x["before"], x["after"], x["kind"]
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0).cast("int")
    form = _by_kind(kind, {k: m.rlike(r) for k, r in STRICT.items()})
    glued = before.rlike("[A-Za-z0-9_]$") | after.rlike("^[A-Za-z0-9_]")
    apart = before.rlike(r"(^|[\s(\[\"'=:,;<])$") & after.rlike(r"^($|[\s)\].,;:!?\"'>])")
    digits = F.length(F.regexp_replace(m, "[^0-9]", ""))
    mail = F.length(m).between(6, 64)
    return F.struct(
        x["s"].alias("s"), x["e"].alias("e"), kind.alias("kind"),
        vote(form, ~form).alias("v_form"),
        F.when(kind == "email", 0).otherwise(vote(ok, ~ok)).alias("v_check"),
        vote(_by_kind(kind, {k: before.rlike(_any(w)) for k, w in CUES.items()}), before.rlike(_any(AGAINST))).alias("v_cue"),
        vote(apart, glued).alias("v_context"),
        F.when(kind == "email", vote(mail, ~mail)).otherwise(vote((digits >= 4) & (F.length(m) <= 200), digits == 0)).alias("v_shape"),
        (F.length(m) >= 16).alias("long"),
    )


# --- the vote patterns, on the driver: a few hundred rows at most ---------------------------


def reliabilities(rows: list[Row], rounds: int = 40) -> tuple[list[float], dict[tuple[str, int, int], float]]:
    """For each vote pattern the posterior of being personal data, and how often each labeler votes how given
    the truth, by expectation-maximisation over labelers that are independent given it.  A tenth of all
    weight is a prior belief that labelers rather agree with the truth, so the two classes keep their names."""
    post = [1 / (1 + math.exp(-sum(r[v] for v in LABELERS))) for r in rows]
    weight = [r["n"] for r in rows]
    total = sum(weight)
    table: dict[tuple[str, int, int], float] = {}
    for _ in range(rounds):
        share = (1 + sum(w * p for w, p in zip(weight, post))) / (total + 2)
        for v in LABELERS:
            for truth in (0, 1):
                mass = {k: 0.1 * total * (0.6 if k == (1 if truth else -1) else 0.2) for k in (-1, 0, 1)}
                for r, w, p in zip(rows, weight, post):
                    mass[r[v]] += w * (p if truth else 1 - p)
                for k, x in mass.items():
                    table[v, truth, k] = x / sum(mass.values())
        for i, r in enumerate(rows):
            yes = math.log(share) + sum(math.log(table[v, 1, r[v]]) for v in LABELERS)
            no = math.log(1 - share) + sum(math.log(table[v, 0, r[v]]) for v in LABELERS)
            post[i] = 1 / (1 + math.exp(min(max(no - yes, -50), 50)))
    return post, table


def _features(r: Row) -> list[float]:
    return [1.0, *(float(r[v]) for v in LABELERS), *(float(r["kind"] == k) for k in KINDS), float(r["long"])]


def classifier(rows: list[Row], rounds: int = 400, rate: float = 0.5) -> list[float]:
    """Weights of a logistic regression on the posteriors."""
    post, x = reliabilities(rows)[0], [_features(r) for r in rows]
    scale = [math.log1p(r["n"]) for r in rows]
    total, w = sum(scale), [0.0] * len(x[0])
    for _ in range(rounds):
        g = [1e-3 * a for a in w]
        for p, f, n in zip(post, x, scale):
            d = n / total * (1 / (1 + math.exp(-sum(a * b for a, b in zip(w, f)))) - p)
            g = [a + d * b for a, b in zip(g, f)]
        w = [a - rate * b for a, b in zip(w, g)]
    return w


def fit(found: DataFrame) -> list[float] | None:
    """The classifier from all matches in found (base, more, failed); without a span none."""
    if found.filter((F.size("base") > 0) | (F.size("more") > 0)).isEmpty():
        return None
    rows = (
        found.select(F.explode(F.concat("base", "more", "failed")).alias("x")).groupBy("x.kind", *[f"x.{v}" for v in LABELERS], "x.long").agg(F.count("*").alias("n")).collect()
    )
    rows.sort(key=lambda r: tuple(map(str, r)))
    return classifier(rows) if rows else None


def accepted(weights: list[float] | None) -> Column:
    """base and those of more that the classifier takes: array of struct(s, rank, e, kind), sorted."""
    flat = lambda x: F.struct(x["s"].alias("s"), F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).alias("rank"), x["e"].alias("e"), x["kind"].alias("kind"))
    base = F.transform("base", flat)
    if weights is None:
        return F.array_sort(base)

    def taken(x: Column) -> Column:
        kinds = F.create_map(*[F.lit(v) for k, w in zip(KINDS, weights[1 + len(LABELERS) :]) for v in (k, float(w))])
        z = F.lit(float(weights[0])) + kinds[x["kind"]] + F.when(x["long"], float(weights[-1])).otherwise(0.0)
        for v, w in zip(LABELERS, weights[1:]):
            z = z + x[v] * float(w)
        return z > 0

    added = F.array_sort(F.transform(F.filter("more", taken), lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), flat(x).alias("x"))))

    def first(added: Column) -> Column:
        upto = _running(F.transform(added, lambda y: -y["e"]), F.greatest)
        return F.transform(_let(upto, lambda u: F.filter(added, lambda y, j: F.coalesce(F.get(u, j - 1), F.lit(0)) <= y["s"])), lambda y: y["x"])

    return F.array_sort(F.concat(base, _let(added, first)))


def _listed(a: str) -> Column:
    return F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def _united(spans: Column) -> Column:
    """Sorted spans as struct(s, e, kind); those that overlap as one, of the kind of the first."""

    def heads(upto: Column) -> Column:
        first = F.filter(F.transform(spans, lambda x, j: F.when(F.coalesce(F.get(upto, j - 1), F.lit(0)) <= x["s"], j)), lambda j: j.isNotNull())
        end = lambda first, k: F.get(upto, F.coalesce(F.get(first, k + 1), F.size(spans)) - 1)
        of = lambda x, e: F.struct(x["s"].alias("s"), e.alias("e"), x["kind"].alias("kind"))
        return _let(first, lambda first: F.transform(first, lambda j, k: of(F.get(spans, j), end(first, k))))

    return _let(_running(F.transform(spans, lambda x: x["e"]), F.greatest), heads)


def _replaced(wide: Column) -> Column:
    """The text of wide, which has four bytes a code point (so that a part is taken without a walk from the start),
    with [KIND] for each of cut.  The x before a part keeps a byte order mark in place."""
    part = lambda a, n: F.substring(F.decode(F.concat(F.lit(bytearray(b"\0\0\0x")), F.substring(wide, 4 * a + 1, 4 * n)), "UTF-32"), F.lit(2), n)
    upto = lambda i: F.coalesce(F.get("cut", i - 1)["e"], F.lit(0))
    parts = F.transform("cut", lambda x, i: F.concat(part(upto(i), x["s"] - upto(i)), F.lit("["), F.upper(x["kind"]), F.lit("]")))
    tail = _let(F.element_at("cut", -1)["e"], lambda e: part(e, (F.length(wide) / 4).cast("int") - e))
    return F.concat(F.array_join(parts, ""), tail)


def redact(docs: DataFrame) -> DataFrame:
    """docs with [KIND] in the text for each span; spans that overlap become one, of the kind of
    the first.  n_chars, if there is such a column, becomes the new length.  A null text stays.
    Texts are scanned once: rows are stored with their matches, for the classifier and for the cut."""
    rest = [c for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest], F.col("text").isNull().alias("__null")).alias("__row"), "text")
    found = stored(spans(packed, ("__row",)), "pii-rows")
    df = found.select("__row", "text", accepted(fit(found)).alias("spans"))
    df = df.withColumn("cut", F.when(F.size("spans") > 0, _united(F.col("spans"))))
    df = df.withColumn("wide", F.when(F.size("spans") > 0, F.encode(F.make_valid_utf8("text"), "UTF-32")))
    text = F.when(F.col("__row.__null"), None).when(F.size("cut") > 0, _let(F.col("wide"), _replaced)).otherwise(F.col("text"))
    df = df.select("__row", text.alias("text"))
    size = F.length("text").cast(dict(docs.dtypes).get("n_chars", "long"))
    return df.select(*[F.col("text") if c == "text" else size.alias(c) if c == "n_chars" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


def op10(docs: DataFrame) -> DataFrame:
    found = stored(spans(docs, ("doc_id",)).drop("text"), "pii")
    df = found.select("doc_id", accepted(None).alias("base"), accepted(fit(found)).alias("spans"))
    of = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return df.select("doc_id", *map(of, BASE), F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))
