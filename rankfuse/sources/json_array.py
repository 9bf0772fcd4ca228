"""Reading one big JSON array in parallel.

Spark's ``multiLine`` reader takes a whole file as one task. Here a file is read in byte ranges,
like lines, with ``}`` as the end of a record: a *piece* is what stands between two closing braces,
whether these close an object or are letters of a string. Which they are depends on all that comes
before, so it takes two passes:

1. every range says what it does to a reader that enters it outside a string, and to one that enters
   it within: how many quotes it turns, how deep it ends, how low it gets. One row for each range
   (a few numbers) goes to the driver, which follows them through each file;
2. every range, now told its state, cuts its pieces into objects. Objects that cross a border
   come as fragments, which meet by the range that they began in.

No brace of an escape sequence or string is taken for a real one, no range needs another one's
bytes, and objects may be longer than a range. Numbers, strings and nulls between the array's objects
are left out; arrays as its elements are not supported. JSON lines and files of one object are read
as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import child_session

ESCAPE = re.compile(rb"\\.", re.DOTALL)
SIGN = re.compile(rb'\\.|["{}\[\]]', re.DOTALL)
SUMMARY = "file long, start long, quotes int, depth_out long, low_out long, depth_in long, low_in long, first int"
OBJECT = "file long, owner long, start long, text binary"
FLUSH = 4 << 20


@dataclass(frozen=True)
class Entry:
    """How a range is entered: within a string or not, how deep, at which depth objects are records,
    and the start of the range in which an object under way began."""

    quoted: bool
    depth: int
    record: int
    owner: int | None


def steps(piece: bytes) -> tuple[list[int], int]:
    """What the parts of a piece between its quotes add to the depth, and the number of quotes."""
    if b"\\" in piece:
        piece = ESCAPE.sub(b"", piece)
    parts = piece.split(b'"')
    return [p.count(b"{") + p.count(b"[") - p.count(b"]") for p in parts], len(parts) - 1


class Summary:
    """What a range does, for both ways to enter it."""

    def __init__(self) -> None:
        self.quotes, self.first = 0, None
        self.depth, self.low = [0, 0], [0, 0]

    def add(self, piece: bytes) -> None:
        if self.first is None and piece.strip():
            self.first = piece.lstrip()[0]
        turns, quotes = steps(piece)
        for way in (0, 1):  # 0: entered outside a string
            self.depth[way] += sum(turns[(self.quotes + way) % 2 :: 2])
        self.quotes = (self.quotes + quotes) % 2
        open_way = self.quotes % 2  # the way of entry by which the closing brace is a real one
        self.depth[open_way] -= 1
        self.low[open_way] = min(self.low[open_way], self.depth[open_way])


def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], bytes]]:
    for batch in batches:
        for file, start, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            yield (file, start), piece


def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple[int, int], Summary] = {}
    for key, piece in ranges(batches):
        found.setdefault(key, Summary()).add(piece)
    rows = [(*key, s.quotes, s.depth[0], s.low[0], s.depth[1], s.low[1], s.first) for key, s in found.items()]
    names = [f.split()[0] for f in SUMMARY.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.int32()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 8, types)], names=names)


def entries(rows: list) -> dict[tuple[int, int], Entry]:
    """Follows the ranges of each file: the state in which each is entered."""
    out: dict[tuple[int, int], Entry] = {}
    file = None
    for r in sorted(rows, key=lambda r: (r["file"], r["start"])):
        if r["file"] != file:
            file, quoted, depth, owner, record = r["file"], False, 0, None, None
        if record is None and r["first"] is not None:
            record = 1 if r["first"] == ord("[") else 0
        out[file, r["start"]] = Entry(quoted, depth, record or 0, owner)
        low, step = (r["low_in"], r["depth_in"]) if quoted else (r["low_out"], r["depth_out"])
        if owner is None or depth + low <= (record or 0):  # what was under way ends here
            owner = r["start"] if depth + step > (record or 0) else None
        depth, quoted = depth + step, quoted != bool(r["quotes"])
    return out


class Cutter:
    """Cuts the pieces of one range into objects: ``done`` holds (owner or None, bytes)."""

    def __init__(self, start: int, entry: Entry):
        self.start, self.quoted, self.depth, self.record = start, entry.quoted, entry.depth, entry.record
        self.owner = entry.owner
        self.held: list[bytes] | None = [] if entry.owner is not None else None
        self.done: list[tuple[int | None, bytes]] = []

    def add(self, piece: bytes) -> None:
        if self.held is None:
            self.walk(piece)
        else:
            turns, quotes = steps(piece)
            self.depth += sum(turns[int(self.quoted) :: 2])
            self.quoted ^= bool(quotes % 2)
            self.held.append(piece)
        if not self.quoted:
            self.depth -= 1
            if self.held is not None and self.depth <= self.record:
                self.done.append((self.owner, b"}".join([*self.held, b""])))
                self.held = self.owner = None

    def walk(self, piece: bytes) -> None:
        """A piece in which an object may begin: sign by sign."""
        begin = None
        for sign in SIGN.finditer(piece):
            c = sign.group()
            if c == b'"':
                self.quoted = not self.quoted
            elif len(c) == 1 and not self.quoted:
                if c == b"{" and self.depth == self.record and begin is None:
                    begin = sign.start()
                self.depth += 1 if c in b"{[" else -1
        if begin is not None:
            self.held = [piece[begin:]]

    def finish(self) -> list[tuple[int | None, bytes]]:
        if self.held:
            self.done.append((self.start if self.owner is None else self.owner, b"}".join([*self.held, b""])))
        return self.done


def cut(known: dict[tuple[int, int], Entry]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in OBJECT.split(", ")]
        types = [pa.int64()] * 3 + [pa.binary()]
        rows: list[tuple] = []
        size, key, cutter = 0, None, None

        def taken(objects: list[tuple[int | None, bytes]]) -> None:
            nonlocal size
            rows.extend((key[0], owner, key[1], text) for owner, text in objects)
            size += sum(len(text) + 32 for _, text in objects)

        for now, piece in ranges(batches):
            if now != key:
                if cutter is not None:
                    taken(cutter.finish())
                key, cutter = now, Cutter(now[1], known[now])
            cutter.add(piece)
            if cutter.done:
                taken(cutter.done)
                cutter.done = []
            if size > FLUSH:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                rows.clear()
                size = 0
        if cutter is not None:
            taken(cutter.finish())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def with_fixed_ranges(spark: SparkSession, split_bytes: int | None) -> SparkSession:
    """A session whose file ranges don't depend on how many executors there are at the moment: both
    passes must see the same ones."""
    size = {"spark.sql.files.maxPartitionBytes": str(split_bytes)} if split_bytes else {}
    return child_session(spark, {"spark.sql.files.minPartitionNum": "1", **size})


def json_objects(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """``text``: one JSON object (a string) for each record of the files at ``path``."""
    own = with_fixed_ranges(spark, split_bytes)
    pieces = own.read.option("lineSep", "}").text(path)
    meta = pieces.metadataColumn("_metadata")
    pieces = pieces.select(F.xxhash64(meta["file_path"]).alias("file"), meta["file_block_start"].alias("start"), F.col("value").cast("binary").alias("piece"))
    known = entries(pieces.mapInArrow(summarise, SUMMARY).collect())
    found = pieces.mapInArrow(cut(known), OBJECT)
    whole = found.where(F.col("owner").isNull()).select(F.col("text").cast("string").alias("text"))
    parts = F.sort_array(F.collect_list(F.struct("start", F.col("text").cast("string").alias("text"))))
    broken = found.where(F.col("owner").isNotNull()).groupBy("file", "owner").agg(parts.alias("parts"))
    joined = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    return whole.unionByName(broken.select(joined.alias("text")))


def read_json_array(spark: SparkSession, path: str, schema: T.StructType, split_bytes: int | None = None) -> DataFrame:
    """The records of JSON arrays (or lines) with this schema, each file read by as many tasks as it has
    ranges of ``split_bytes`` (the session's ``spark.sql.files.maxPartitionBytes`` unless given)."""
    text = json_objects(spark, path, split_bytes)
    return text.select(F.from_json("text", schema).alias("r")).select("r.*")


def write_json_array(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Each partition as a file that is one pretty-printed JSON array."""
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "["
        for batch in batches:
            out = []
            for obj in batch.column(0).to_pylist():
                out.append(lead + obj)
                lead = ","
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
        if lead == ",":
            yield pa.RecordBatch.from_arrays([pa.array(["]"], pa.string())], names=["value"])

    rows = df.select(F.to_json(F.struct(*df.columns), {"pretty": "true"}).alias("value"))
    rows.mapInArrow(lines, "value string").write.mode(mode).text(path)
