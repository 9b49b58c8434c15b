"""``spark.read.format("payloads")`` and ``spark.readStream.format("payloads")``: objects of loosely formatted JSON files.

A row for each object: file, pos (orders the objects of a file) and item (JSON text), as ``ingest.payload_items`` gives
them for whole files: an object with samples, a list, one object, or objects line by line, in a fence or not.

Partitions are made by bytes.  Files named .jsonl, or all with the option lines, hold an object (or one with samples) in each line; they are cut
at ``partitionBytes``, and a part has the lines that begin in it.  Other files have a shape of their own and are
read whole, small ones together up to as many bytes.

A stream takes the files in order of their time of modification and path; an offset is that of the last file
taken, so its size doesn't grow.  Files have to be moved into the folder whole; one that appears with an
older time than those taken is not read.

Options: path, partitionBytes (128 MB), glob (of names, * if absent), lines (true or false).  Stores are those that Arrow reads (local and
mounted folders, hdfs, s3, gs).  Files and folders whose name begins with a dot or an underscore are passed over.
Defined cases: an empty folder gives no rows, as do empty files and bad lines; bytes that are no UTF-8 are replaced.
Objects that name a key twice, and values beyond JSON (NaN), are bad.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from fnmatch import fnmatch

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

PARTITION_BYTES = 128 << 20
_FENCE = re.compile(r"```(?:json)?[ \t\n\x0b\f\r]*(.*?)```", re.S)
#: White space of JVM patterns.
_SPACE = " \t\n\x0b\f\r"


def _pairs(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a key stands twice")
    return out


def _bad(name: str):
    raise ValueError(name)


def parsed(text: str):
    """The value of a JSON text; ValueError where it is none."""
    return json.loads(text, object_pairs_hook=_pairs, parse_constant=_bad)


def _objects(value, listed: bool) -> Iterator[tuple[int, dict]]:
    """The objects of a value with their places among its items."""
    if isinstance(value, dict):
        many = value.get("samples")
        value = many if isinstance(many, list) else [value]
    elif not (listed and isinstance(value, list)):
        return
    yield from ((at, x) for at, x in enumerate(value) if isinstance(x, dict))


def _text(x: dict) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def objects(text: str) -> Iterator[tuple[int, str]]:
    """pos and item of each object of a whole payload."""
    fenced = _FENCE.search(text)
    body = (fenced[1] if fenced else text).strip(_SPACE)
    if body[:1] in ("[", "{"):
        try:
            whole = parsed(body)
        except (ValueError, RecursionError):
            pass
        else:
            yield from ((at, _text(x)) for at, x in _objects(whole, True))
            return
    lines = [x for x in (line.strip(" ").rstrip(",") for line in re.split(r"\r?\n", body)) if x]
    for i, line in enumerate(lines):
        yield from of_line(line, i)


def of_line(line: str, place: int) -> Iterator[tuple[int, str]]:
    try:
        value = parsed(line)
    except (ValueError, RecursionError):
        return
    yield from ((place * (1 << 32) + at, _text(x)) for at, x in _objects(value, False))


class Part(InputPartition):
    """Pieces of files: (path, begin, end), end None for a whole file."""

    def __init__(self, pieces: list[tuple[str, int, int | None]]):
        self.pieces = pieces


class Files:
    """Listing and reading, on driver and executors."""

    def __init__(self, options: dict):
        self.path = options.get("path") or _bad("the option path is missing")
        self.bytes, self.glob = int(options.get("partitionBytes") or PARTITION_BYTES), options.get("glob") or "*"
        self.lines = str(options.get("lines")).lower() == "true"

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def listed(self) -> list[tuple[int, str, int]]:
        """(time in ns, path, bytes) of all files, in that order."""
        from pyarrow import fs

        store, root = self._store()
        if store.get_file_info(root).type == fs.FileType.File:
            found = [store.get_file_info(root)]
        else:
            found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        hidden = lambda path: any(x[:1] in "._" for x in path.removeprefix(root).split("/") if x)
        kept = [f for f in found if f.type == fs.FileType.File and not hidden(f.path) and fnmatch(f.base_name, self.glob)]
        return sorted((f.mtime_ns or 0, f.path, f.size) for f in kept)

    def parts(self, files: list[tuple[int, str, int]]) -> list[Part]:
        out, held, size = [], [], 0
        for _, path, n in sorted(files, key=lambda f: f[1]):
            if self.lines or path.endswith(".jsonl"):
                pieces = [(path, at, min(at + self.bytes, n)) for at in range(0, n, self.bytes)]
            else:
                pieces = [(path, 0, None)]
            for piece in pieces:
                own = n if piece[2] is None else piece[2] - piece[1]
                if held and size + own > self.bytes:
                    out.append(Part(held))
                    held, size = [], 0
                held.append(piece)
                size += own
        return out + [Part(held)] * bool(held)

    def rows(self, part: Part) -> Iterator[tuple[str, int, str]]:
        store, _ = self._store()
        for path, begin, end in part.pieces:
            if end is None:
                with store.open_input_stream(path) as f:
                    text = f.read().decode("utf-8", "replace")
                yield from ((path, pos, item) for pos, item in objects(text))
                continue
            with store.open_input_file(path) as f:
                yield from ((path, pos, item) for at, line in lines_of(f, begin, end) for pos, item in of_line(line.strip(_SPACE).rstrip(","), at))


def lines_of(f, begin: int, end: int, step: int = 1 << 20) -> Iterator[tuple[int, str]]:
    """(byte, text) of the lines of an open file that begin in [begin, end)."""
    f.seek(max(begin - 1, 0))
    at, rest = max(begin - 1, 0), b""
    skip = begin > 0  # up to and with the first line end from begin - 1 on
    while at < end:
        more = f.read(step)
        rest += more
        cut = rest.split(b"\n")
        whole, rest = (cut[:-1], cut[-1]) if more else (cut, b"")
        for line in whole:
            if skip:
                skip = False
            elif at >= end:
                return
            elif line:
                yield at, line.decode("utf-8", "replace")
            at += len(line) + 1
        if not more:
            return


class PayloadReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = Files(options)

    def partitions(self) -> list[Part]:
        return self.files.parts(self.files.listed()) or [Part([])]

    def read(self, partition: Part) -> Iterator[tuple]:
        return self.files.rows(partition)


class PayloadStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.files = Files(options)

    def initialOffset(self) -> dict:
        return {"time": "-1", "path": ""}  # times as text: they are beyond what a JSON double holds

    def latestOffset(self) -> dict:
        found = self.files.listed()
        return {"time": str(found[-1][0]), "path": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Part]:
        low, high = ((int(x["time"]), x["path"]) for x in (start, end))
        return self.files.parts([f for f in self.files.listed() if low < f[:2] <= high]) or [Part([])]

    def read(self, partition: Part) -> Iterator[tuple]:
        return self.files.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class PayloadSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "payloads"

    def schema(self) -> str:
        return "file string, pos long, item string"

    def reader(self, schema) -> PayloadReader:
        return PayloadReader(dict(self.options))

    def streamReader(self, schema) -> PayloadStream:
        return PayloadStream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PayloadSource)
