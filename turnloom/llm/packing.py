"""Packing by concatenation and cutting.

First pass: each partition encodes its documents and gives, for each, its tokens and the
number of tokens before it in the partition.  Prefix sums over the partitions' totals (a row
for each partition) then give every document its place in one long sequence; the second pass
cuts that at multiples of the window, with a record for each piece between two boundaries.
All windows but the last are full.

The encoder keeps what chunks (a space and what follows up to the next) become.  The
vocabulary's pre-tokens begin at a space or inside such a chunk, never across its start,
as long as a chunk does not begin with further white space; those that do are joined to
the chunk before.

Defined cases: a null or empty text has only the end id.  A very long text is encoded whole, as
one row, and cut into pieces.  Repeated rows are packed each.  Without rows the result is empty.  Further columns are dropped.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import arrow_batches, stored

WINDOW = 2048
END = 1
#: Chunks that an encoder keeps; then it begins anew.
KEPT = 600_000
#: Characters of the longest chunk that is kept, so that what is kept is bounded in bytes (some 150 MB).
LONGEST = 48
#: The split of byte-level BPE before merging (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ODD = re.compile(r" (?:\s|\Z)")
_encoders: dict[str, Encoder] = {}


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder(dict):
    """text -> ids of the byte-level BPE in a tokenizer.json, as little-endian unsigned 16-bit
    numbers.  As a dict it holds the ids of chunks that follow a space."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in k): v for k, v in model["vocab"].items() if all(c in byte for c in k)}
        ranks = {k: v for k, v in ranks.items() if v < len(model["merges"]) + 256}
        if max(ranks.values()) >= 1 << 16:
            raise ValueError("ids above 65535")
        self.ends: dict[str, bytes] = {}
        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.ends = {c: self.whole(c) for c in ".,!?;:"}

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isalpha():
            ids = array("H", self.bpe._core_bpe.encode_single_piece((" " + chunk).encode())).tobytes()
        elif chunk[-1:] in self.ends and chunk[:-1].isalpha():
            ids = self[chunk[:-1]] + self.ends[chunk[-1]]
        else:
            ids = self.whole(" " + chunk)
        if len(chunk) <= LONGEST:
            self[chunk] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return array("H", self.bpe.encode_ordinary(text)).tobytes()

    def __call__(self, text: str) -> bytes:
        if len(self) > KEPT:
            self.clear()
        first, *rest = text.split(" ")
        if _ODD.search(text):
            chunks = [first]
            for x in rest:
                if not x or x[0].isspace():
                    chunks[-1] += " " + x
                else:
                    chunks.append(x)
            first, *rest = chunks
        return self.whole(first) + (b"".join(itemgetter(*rest)(self)) if len(rest) > 1 else b"".join(self[x] for x in rest))


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """part, before (tokens before it in its part), doc_id (as a string, so that pandas keeps it
    beside nulls), tokens, ids (16-bit numbers)."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, part, before, last = encoder(tokenizer), TaskContext.get().partitionId(), 0, array("H", [end]).tobytes()
        for b in batches:
            ids = [encode(t or "") + last for t in b["text"]]
            n = pd.Series([len(x) // 2 for x in ids], dtype="int64")
            yield pd.DataFrame({"part": part, "before": before + n.cumsum() - n, "doc_id": b["doc_id"], "tokens": n, "ids": ids})
            before += int(n.sum())

    return docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, "part int, before long, doc_id string, tokens long, ids binary")


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset
    (and ids, little-endian unsigned 32-bit numbers, if with_ids)."""
    rows = stored(encoded(docs, tokenizer, end), "packing")
    totals = rows.groupBy("part").agg(F.sum("tokens").alias("n"))
    offsets = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    # a row for each partition of the first pass
    at = rows.join(F.broadcast(offsets), "part").select("doc_id", "tokens", (F.col("base") + F.col("before")).alias("at"), "ids")
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for b in batches:
            out = []
            for doc, n, place, ids in zip(b["doc_id"], b["tokens"], b["at"], b["ids"]):
                raw, start = np.frombuffer(ids, "<u2").astype("<u4").tobytes(), 0
                while start < n:
                    offset = (place + start) % window
                    length = min(window - offset, n - start)
                    piece = raw[4 * start : 4 * (start + length)]
                    out.append((doc, start, length, zlib.crc32(piece), n, (place + start) // window, offset) + ((piece,) if with_ids else ()))
                    start += length
            yield pd.DataFrame(out, columns=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    schema = f"doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return at.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast(kind))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5(docs: DataFrame) -> DataFrame:
    return pack(docs, tokenizer_path())
