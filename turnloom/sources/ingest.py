"""Readers of JSON lines and of loosely formatted JSON payloads."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from fnmatch import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.text import strip
from ..operators.dedup import union_all
from ..operators.dialogue import chat_messages, seed_samples
from ..schema import CONVERSATIONS_RECORD, SAMPLE, TURNS


def jsonl(spark: SparkSession, path: str | list[str], schema: str, mode: str = "strict") -> DataFrame:
    """JSON lines: "strict" fails at a bad line, "blanks" also skips blank lines, "tolerant" drops bad lines."""
    if mode == "blanks":
        lines = spark.read.text(path).filter(strip(F.col("value")) != "")
        return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return spark.read.schema(schema).option("mode", {"strict": "FAILFAST", "tolerant": "DROPMALFORMED"}[mode]).json(path)


def whole_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, value: one row for each file."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths that are there, in any store that Spark reads."""
    jvm, out = spark._jvm, []
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            out.append(p)
    return out


def first_existing(spark: SparkSession, explicit: str | None, patterns: list[str], fallbacks: list[str]) -> str | None:
    """The explicit path, else the first match of a pattern (** for folders at any depth), else the first
    fallback that is there, in any store that Spark reads."""
    if explicit and existing(spark, [explicit]):
        return explicit
    for p in patterns:
        if found := _matching(spark, p):
            return found[0]
    return next(iter(existing(spark, fallbacks)), None)


def _matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, sorted, written as the pattern is (with or without a scheme)."""
    of, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    head, deep, tail = pattern.partition("/**/")
    fs = of(head).getFileSystem(conf)
    if deep:
        if not fs.exists(of(head)):
            return []
        files, found = fs.listFiles(of(head), True), []
        while files.hasNext():
            found.append(files.next().getPath())
        found = [p for p in found if fnmatch(p.getName(), tail)]
    else:
        found = [s.getPath() for s in fs.globStatus(of(pattern)) or ()]
    bare = of(head).toUri().getScheme() is None
    return sorted(p.toUri().getPath() if bare else p.toString() for p in found)


def unfenced(c: Column) -> Column:
    """The first fenced block, else the text; stripped."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.regexp_replace(F.when(c.rlike(r"(?s)```(?:json)?\s*.*?```"), fenced).otherwise(c), r"^\s+|\s+$", "")


def _values(text: Column) -> Column:
    """The values of a JSON text in brackets, as the parser alone does not mind what follows a value; null where it is bad."""
    return F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")


def payload_items(df: DataFrame, text: str = "value") -> DataFrame:
    """df with pos and item (JSON text of one object) for each object of a payload: an object with
    samples, a list, one object, or objects line by line, each a sample or with samples; other lines
    (lists among them) and items are dropped."""
    body = unfenced(F.col(text))
    one = F.size(_values(body)) == 1
    lines = F.filter(F.transform(F.split(body, r"\r?\n"), lambda x: F.regexp_replace(F.trim(x), r",+$", "")), lambda x: x != "")
    parts = F.when(one & body.rlike(r"^[\[{]"), F.array(body)).otherwise(lines)
    kept = [c for c in df.columns]
    df = df.select(*kept, one.alias("__one"), F.posexplode(parts).alias("__line", "__part"))
    values = _values(F.col("__part"))
    v = F.when(F.size(values) == 1, F.get(values, F.lit(0)))
    listed = F.col("__part").startswith("[")
    many = F.when(listed, F.expr("try_variant_get(v, '$', 'array<variant>')")).otherwise(F.expr("try_variant_get(v, '$.samples', 'array<variant>')"))
    df = df.withColumn("v", v).filter(F.col("v").isNotNull() & (F.coalesce("__one", F.lit(False)) | ~listed))
    items = F.coalesce(many, F.array("v"))
    out = df.select(*kept, "__line", F.posexplode(items).alias("__at", "item")).withColumn("item", F.to_json("item")).filter(F.col("item").startswith("{"))
    return out.withColumn("pos", (F.col("__line").cast("long") * (1 << 32) + F.col("__at"))).drop("__line", "__at")


def samples(items: DataFrame) -> DataFrame:
    """Items with their fields as a sample."""
    return items.withColumn("s", F.from_json("item", SAMPLE)).select("*", "s.*").drop("s")


@udtf(returnType=StructType([StructField("pos", IntegerType()), StructField("item", StringType())]))
class RecoverObjects:
    """Complete objects of a JSON text that breaks off: those in the list after "samples" (or the
    first list).  Nesting and strings are not regular, so no pattern finds them."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        pos = 0
        for item in whole_objects(text or ""):
            try:
                json.loads(item)
            except ValueError:
                continue
            yield pos, item
            pos += 1


def whole_objects(text: str) -> Iterator[str]:
    """Texts between braces that match, outside of strings, from the list on."""
    at = text.find("[", max(text.find('"samples"'), 0))
    depth, opened, quoted = 0, -1, False
    while at >= 0 and (m := (_IN_STRING if quoted else _OUTSIDE).search(text, at)):
        at, sign = m.end(), m[0]
        if sign == '"':
            quoted = not quoted
        elif sign == "{":
            opened = m.start() if depth == 0 else opened
            depth += 1
        elif sign == "}":
            depth -= 1
            if depth == 0 and opened >= 0:
                yield text[opened:at]
                opened = -1


_OUTSIDE, _IN_STRING = re.compile(r'["{}]'), re.compile(r'"|\\.', re.S)


def recovered(df: DataFrame, text: str) -> DataFrame:
    """Strict parsing where it gives samples, else what can be recovered: df with pos and item."""
    strict = df.withColumn("__n", F.expr(f"coalesce(size(try_variant_get(try_parse_json({text}), '$.samples', 'array<variant>')), 0)"))
    good = strict.filter("__n > 0").drop("__n")
    good = good.select(*df.columns, F.posexplode(F.expr(f"try_variant_get(try_parse_json({text}), '$.samples', 'array<variant>')")).alias("pos", "v")).withColumn("item", F.to_json("v")).drop("v")
    spark = df.sparkSession
    spark.udtf.register("recover_objects", RecoverObjects)
    bad = strict.filter("__n <= 0").drop("__n")
    bad = spark.sql(f"select t.*, r.pos, r.item from {{t}} t, lateral recover_objects(t.{text}) r", t=bad)
    return good.unionByName(bad)


def literal(spark: SparkSession, text: str, schema: str) -> DataFrame:
    """A JSON argument as one row."""
    return spark.range(1).select(F.from_json(F.lit(text), schema).alias("r")).select("r.*") if not schema.startswith("array") else spark.range(1).select(F.from_json(F.lit(text), schema).alias("r"))


def request(spark: SparkSession, body: str) -> DataFrame:
    """The turns of a request {"conversation": [...]} as one row; ValueError unless there is a turn and all have a role and a text."""
    df = spark.range(1).select(F.from_json(F.lit(body), f"conversation {TURNS}").alias("r")).select(F.col("r.conversation").alias("turns"))
    good = F.coalesce((F.size("turns") >= 1) & F.forall("turns", lambda t: F.coalesce(t["role"].isin("user", "bot") & (F.char_length(t["content"]) >= 1), F.lit(False))), F.lit(False))
    if not df.select(good).first()[0]:
        raise ValueError("a conversation needs at least one turn, each with role user or bot and a content")
    return df


def seed_pool(curated: DataFrame, records: DataFrame) -> DataFrame:
    """Curated samples and, after them, benchmark records (conversations, meta) as samples."""
    return union_all(curated, seed_samples(records))


def training(spark: SparkSession, train: str, valid: str) -> DataFrame:
    """Messages of both files with their split; records with messages pass as they are, conversations are renamed, other columns go."""
    schema = f"{CONVERSATIONS_RECORD}, messages {TURNS}"
    files = [spark.read.schema(schema).json(p).withColumn("split", F.lit(n)) for p, n in ((train, "train"), (valid, "validation"))]
    return union_all(*files).select("split", F.coalesce("messages", chat_messages(F.col("conversations"))).alias("messages"))
