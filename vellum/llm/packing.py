"""Packing: documents cut and placed into sequences of a fixed number of tokens, by bounded-space online packing.

Every partition keeps a fixed number of open windows. A document's whole windows go out at once; the rest goes to the open
window that it fits best. If none has room, a new one opens while there are fewer than the fixed number, else the fullest is
filled up with the head of the rest and emitted. What is left open at a partition's end is merged, emptiest windows into the
fullest, so that at most one window of a partition stays short; these meet in groups of ``GROUP`` partitions, round after
round, until one is left. That one is cut into sequences whose lengths are powers of two, which need no padding.

Only short windows travel between partitions: less than one sequence of ids from each.

Defined results: a null text counts as empty and an empty one is its end token; repeated rows are packed each; a null id stays
null; an empty table gives no rows; long texts are cut into many pieces. Columns other than the two named are not read.
"""

from __future__ import annotations

import bisect
import functools
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from vellum.llm.chunks import ChunkCache, tokenizer
from vellum.llm.common import cut, small_batches

SIZE, OPEN, GROUP = 4096, 64, 64
#: Chunks kept in each of the cache's two generations.
KEPT = 400_000
_PLAIN = re.compile(r"[\s!-~À-ÖØ-öø-ÿ]*").fullmatch
_PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


class Window:
    """An open sequence: pieces (id, start, document's tokens, ids) and the tokens they take."""

    __slots__ = ("pieces", "used")

    def __init__(self):
        self.pieces, self.used = [], 0

    def put(self, piece: tuple) -> None:
        self.pieces.append(piece)
        self.used += len(piece[3]) // 4


def split(piece: tuple, n: int) -> tuple[tuple, tuple]:
    """A piece's first n tokens, and the rest."""
    key, start, total, ids = piece
    return (key, start, total, ids[: 4 * n]), (key, start + n, total, ids[4 * n :])


class Packer:
    """Open windows of one partition, by what they hold."""

    def __init__(self, size: int = SIZE, most: int = OPEN):
        self.size, self.most = size, most
        self.used: list[int] = []  # ascending, beside the windows
        self.windows: list[Window] = []

    def open(self, w: Window) -> None:
        at = bisect.bisect_left(self.used, w.used)
        self.used.insert(at, w.used)
        self.windows.insert(at, w)

    def _take(self, at: int) -> Window:
        del self.used[at]
        return self.windows.pop(at)

    def add(self, piece: tuple) -> Iterator[Window]:
        """Place a document; windows that become full come out."""
        while (n := len(piece[3]) // 4) >= self.size:
            w = Window()
            head, piece = split(piece, self.size)
            w.put(head)
            yield w
        while n := len(piece[3]) // 4:
            at = bisect.bisect_right(self.used, self.size - n) - 1  # the fullest with room for all of it
            if at >= 0:
                w, head, rest = self._take(at), piece, None
            elif len(self.windows) < self.most:
                w, head, rest = Window(), piece, None
            else:
                w = self._take(len(self.windows) - 1)
                head, rest = split(piece, self.size - w.used)
            w.put(head)
            if w.used == self.size:
                yield w
            else:
                self.open(w)
            if rest is None:
                return
            piece = rest

    def close(self) -> Iterator[Window]:
        """Merge what is open, emptiest into fullest; at most the last to come out is short."""
        while len(self.windows) > 1:
            full, low = self._take(len(self.windows) - 1), self._take(0)
            while low.pieces and full.used < self.size:
                piece = low.pieces.pop()
                head, rest = split(piece, min(len(piece[3]) // 4, self.size - full.used))
                low.used -= len(piece[3]) // 4
                full.put(head)
                if rest[3]:
                    low.put(rest)
            if full.used == self.size:
                yield full
                if low.pieces:
                    self.open(low)
            else:
                self.open(full)
        if self.windows:
            yield self._take(0)


def powers(w: Window) -> Iterator[Window]:
    """A window cut into windows whose lengths are powers of two, longest first."""
    pieces = w.pieces[::-1]
    for bit in reversed(range(w.used.bit_length())):
        if w.used >> bit & 1:
            part = Window()
            while part.used < 1 << bit:
                piece = pieces.pop()
                head, rest = split(piece, min(len(piece[3]) // 4, (1 << bit) - part.used))
                part.put(head)
                if rest[3]:
                    pieces.append(rest)
            yield part


def _rows(w: Window, sequence: int, with_ids: bool) -> Iterator[tuple]:
    at = 0
    for key, start, total, ids in w.pieces:
        yield key, start, len(ids) // 4, zlib.crc32(ids), total, sequence, at, ids if with_ids else None
        at += len(ids) // 4


@functools.lru_cache(maxsize=1)
def _cache(blob: str) -> ChunkCache:
    t = tokenizer(blob)
    return ChunkCache(lambda chunks: [array("I", e.ids).tobytes() for e in t.encode_batch_fast(chunks, add_special_tokens=False)], KEPT)


def chunks_of(text: str) -> list[str]:
    """A text cut at spaces and line ends, in lower case if it is of ASCII and Latin-1 letters alone; in others case may change what characters are composed."""
    return (text.lower() if _PLAIN(text) else text).replace("\n", " ").split(" ")


def encoded(batches, blob: str, end: int) -> Iterator[tuple[object, bytes]]:
    """Id and ids (little-endian uint32, with the end token) of every row of Arrow batches of id and text.

    The tokenizer drops white space, and no token spans it, so texts are encoded chunk by chunk between spaces and line ends.
    """
    cache, tail = _cache(blob), array("I", [end]).tobytes()
    for batch in batches:
        chunks = [chunks_of(t or "") for t in batch.column(1).to_pylist()]
        known = cache.of({c for cs in chunks for c in cs})
        for key, cs in zip(batch.column(0).to_pylist(), chunks, strict=True):
            yield key, b"".join(map(known.__getitem__, cs)) + tail


def pack(
    docs: DataFrame, tokenizer_path: str, *, end: int, size: int = SIZE, open_windows: int = OPEN, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text", ids: bool = False
) -> DataFrame:
    """A row for each piece: id_col, start (its document's tokens before it), length, ids_crc32, doc_tokens (end token included),
    sequence_id, offset (in the sequence, gapless from 0)[, ids binary: little-endian uint32].

    ``tokenizer_path``: a file of the tokenizers library that drops white space and case; ``end``: the token that ends each document.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        blob = spark.sparkContext.broadcast(f.read())
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = f"id {slim.schema['id'].dataType.simpleString()}, {_PIECE}, part long"
    names = [c.split()[0] for c in schema.split(", ")]

    def columns(rows: list[tuple], part: int, key_type: pa.DataType) -> list[pa.Array]:
        key, *numbers, tokens = zip(*rows, strict=True)
        return [pa.array(key, key_type), *(pa.array(c, pa.int64()) for c in numbers), pa.array(tokens, pa.binary()), pa.array([part] * len(rows), pa.int64())]

    def first(batches):
        task = TaskContext.get().partitionId()
        packer, rows, number, key_type = Packer(size, open_windows), [], task << 32, None
        for batch in batches:
            key_type = batch.schema.field(0).type
            for key, tokens in encoded([batch], blob.value, end):
                for w in packer.add((key, 0, len(tokens) // 4, tokens)):
                    rows += _rows(w, number, ids)
                    number += 1
                if len(rows) >= (500 if ids else 5_000):
                    yield pa.RecordBatch.from_arrays(columns(rows, task, key_type), names)
                    rows = []
        for w in packer.close():
            short = w.used < size
            rows += _rows(w, -1 if short else number, ids or short)
            number += 1
        if rows:
            yield pa.RecordBatch.from_arrays(columns(rows, task, key_type), names)

    def merge(level: int, last: bool):
        def run(key, table):
            part = key[0].as_py()
            packer, rows, number, windows = Packer(size, group), [], (level << 56) + (part << 32), {}
            for r in sorted(table.to_pylist(), key=lambda r: (r["part"], r["offset"])):
                windows.setdefault(r["part"], Window()).put((r["id"], r["start"], r["doc_tokens"], r["ids"]))
            for w in windows.values():
                packer.open(w)
            for w in packer.close():
                for whole in powers(w) if last and w.used < size else [w]:
                    short = whole.used < size and not last
                    rows += _rows(whole, -1 if short else number, ids or short)
                    number += 1
            return pa.Table.from_arrays(columns(rows, part, table.schema.field("id").type), names)

        return run

    placed = cut(slim.mapInArrow(first, schema))
    done, level, parts = [placed.where("sequence_id >= 0")], 0, placed.rdd.getNumPartitions()
    while level == 0 or parts > 1:
        level, parts = level + 1, -(-parts // group)
        # a short window from each of ``group`` parts at most meet in a task
        short = placed.where("sequence_id < 0").withColumn("g", F.floor(F.col("part") / group).cast("long"))
        placed = cut(short.groupBy("g").applyInArrow(merge(level, parts <= 1), schema))
        done.append(placed.where("sequence_id >= 0"))
    pieces = functools.reduce(DataFrame.unionByName, done).drop("part", *([] if ids else ["ids"]))
    return pieces.withColumnRenamed("id", id_col)


def sequences(pieces: DataFrame, *, size: int = SIZE, pad: int = 0) -> DataFrame:
    """From pieces with ids: sequence_id, ids (little-endian uint32), n_tokens; padded to ``size`` unless the length is a power of two."""
    whole = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))
    joined = F.aggregate("p", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    short = (F.col("n_tokens") < size) & (F.bit_count("n_tokens") != 1)
    padding = F.unhex(F.expr(f"repeat('{pad.to_bytes(4, 'little').hex()}', cast({size} - n_tokens as int))"))
    return whole.select("sequence_id", F.when(short, F.concat(joined, padding)).otherwise(joined).alias("ids"), "n_tokens")
