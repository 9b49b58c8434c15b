"""Plain Python versions of the contracts, for small tables."""

import hashlib
import re
from collections import Counter

SEP3 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return (t or "").translate(UP)


def op3(docs, bench, size=13):
    wins = {}
    for item, text in bench:
        w = SEP3.findall(lower(text))
        for i in range(max(len(w) - size + 1, 1) if w else 0):
            wins.setdefault(tuple(w[i : i + size]), set()).add(item)
    lengths = {len(k) for k in wins}
    out = []
    for d, text in docs:
        w = SEP3.findall(lower(text))
        hit, items = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in wins:
                    hit |= set(range(i, i + n))
                    items |= wins[k]
        ids = ",".join(sorted(str(x) for x in items if x is not None))
        out.append((d, len(w), len(hit), len([x for x in items if x is not None]), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def op6(docs):
    out = []
    for d, text in docs:
        text = text or ""
        w = WS.findall(text)
        wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        c = Counter(wins)
        rep = set()
        for i, k in enumerate(wins):
            if c[k] > 1:
                rep |= set(range(i, i + 8))
        seen, dup = set(), 0
        for line in text.split("\n"):
            if WS.search(line):
                dup += line in seen
                seen.add(line)
        n, r = len(w), len(rep)
        out.append((d, n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, r, n < 20 or 100 * r > 30 * n))
    return out


def op9(docs):
    import xxhash

    fps = []
    for _, text in docs:
        w = WS.findall(lower(text))
        runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    distinct = sorted(set(fps))
    root = {f: f for f in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for (d, _), f in zip(docs, fps):
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return [(d, f"{f:016x}", least.get(find(f))) for (d, _), f in zip(docs, fps)]


def op5(rows, docs, ids_of):
    """What is wrong with pieces (doc_id, start, length, crc, doc_tokens, sequence_id, offset) of docs with distinct ids."""
    import struct
    import zlib

    ids = {d: [*ids_of(t or ""), 1] for d, t in docs}
    by_doc, by_seq = {}, {}
    for d, start, length, crc, total, seq, offset in rows:
        part = ids[d][start : start + length]
        assert total == len(ids[d]) and len(part) == length > 0
        assert zlib.crc32(struct.pack(f"<{length}I", *part)) == crc
        by_doc.setdefault(d, []).append((start, length))
        by_seq.setdefault(seq, []).append((offset, length))
    assert set(by_doc) == set(ids)
    for d, x in by_doc.items():
        at = 0
        for start, length in sorted(x):
            assert start == at
            at += length
        assert at == len(ids[d])
    for x in by_seq.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_seq) == -(-sum(map(len, ids.values())) // 2048)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def pii(text):
    text, out = text or "", []
    digits = lambda m: re.sub("[^0-9]", "", m)
    for rank, (kind, rx, ok) in enumerate((
        ("email", EMAIL, lambda m: True),
        ("ip", IP, lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", CARD, lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", PHONE, lambda m: 9 <= len(digits(m)) <= 15),
    )):
        out += [(m.start(), rank, m.end(), kind) for m in rx.finditer(text) if ok(m[0])]
    return sorted(out)


def op10(docs):
    out = []
    for d, text in docs:
        x = pii(text)
        n = Counter(s[3] for s in x)
        base = ",".join(f"{k}:{s}:{e}" for s, _, e, k in x)
        out.append((d, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(base.encode()).hexdigest()))
    return out


def op7(docs):
    """Without the model's own score."""
    import math
    import zlib

    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    toks = lambda t: [*WS.findall(lower(t)), None]
    c = Counter(x for d, t in docs if not held(d) for x in toks(t))
    n, v = sum(c.values()), len(c)
    out = []
    for d, t in docs:
        x = toks(t)
        out.append((d, held(d), len(x), sum(c[y] > 0 for y in x), n, sum(math.log10((c[y] + 0.1) / (n + 0.1 * (v + 1))) for y in x)))
    return out


def op4(rows):
    """turns and loss of each conversation: rows (conv_id, turn, role, text)."""
    hard = r"\### Assistant: </turn> ok"
    rows = [*rows, (-7, 0, "user", hard), (-7, 1, "assistant", hard)]
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for c, x in by.items():
        x.sort()
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        loss = "".join(t for *_, r, t in x if r == "assistant")
        out.append((c, len(x), sha("".join(f"{r}\n{t}\n" for *_, r, t in x)), len(loss), sha(loss)))
    return out


def sentences(text, window=9):
    """Lists of words: cut after ends of sentences and lines, and in each row of so many words without one after the word of
    the least CRC, the last of equal ones."""
    import zlib

    words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text or "")]
    text = text or ""
    last = lambda k: k == len(words) - 1 or "\n" in text[words[k][1] : words[k + 1][0]] or text[words[k][1] - 1] in ".!?"
    end = [last(k) for k in range(len(words))]
    value = [zlib.crc32(text[s:e].encode()) >> 2 for s, e in words]
    cuts = {k for k, x in enumerate(end) if x}
    for k in range(len(words) - window + 1):
        if not any(end[k : k + window]):
            least = min(value[k : k + window])
            cuts.add(max(j for j in range(k, k + window) if value[j] == least))
    out, own = [], []
    for k, (s, e) in enumerate(words):
        own.append(text[s:e])
        if k in cuts:
            out.append(own)
            own = []
    return out


def op2(docs, least_sentences=2, least_words=15):
    """(doc_id, n_sentences, n_removed) for documents with distinct ids, spans compared as words."""
    first, spans, size = {}, [], {}
    for d, text in sorted(docs):
        s = sentences(text)
        size[d] = len(s)
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                if j - i >= least_sentences and sum(map(len, s[i:j])) >= least_words:
                    key = tuple(map(tuple, s[i:j]))
                    spans.append((d, i, j, key))
                    first.setdefault(key, (d, i))
                    break
    gone = {}
    for d, i, j, key in spans:
        if first[key] != (d, i):
            gone.setdefault(d, set()).update(range(i, j))
    return [(d, size[d], len(gone.get(d, ()))) for d, _ in docs]
