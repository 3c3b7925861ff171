"""Cross-tokenizer alignment: two tokenizers' tokens of the same text, grouped and linked by the bytes they cover.

Interval coalescing: the tokens of both are sorted by start, the running maximum of their ends is taken, and a group breaks where a
start reaches it; within a group each token meets those of the other side whose byte ranges overlap its own.

No token of either crosses a place where white space follows another character, so texts are cut there, each different piece is
aligned once a worker while it is in use, and a text's groups and links are those of its pieces. The id pairs that a
document links, with their counts, are stored; Spark counts the documents of every pair, and the pairs found in most documents, at most
``HEAD`` of them, go to all tasks. Links of any other pair are joined with their counts by a shuffle.

Defined results: null and empty texts, and texts of which either tokenizer does not give back the bytes, have no tokens: zeros and an empty
string of groups; repeated rows are documents each and count each; null ids stay null; an empty table gives no rows; other columns are
not read. A piece without white space inside is held whole by the task that aligns it.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from vellum.llm.chunks import ChunkCache, tokenizer
from vellum.llm.common import cut, small_batches

#: Most pairs whose counts are sent to all tasks, 12 bytes each.
HEAD = 1 << 18
_PIECES = re.compile(r"(?<=\S)(?=[ \n])").split
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def byte_level(token: str) -> bytes:
    """The bytes that a byte-level token stands for: printable Latin-1 characters stand for their codes, those from 256 on for the rest in order."""
    return bytes(map(_BYTE_OF.__getitem__, token))


_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_OF = {chr(b): b for b in _SHOWN} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(_SHOWN))}


def piece_bytes(piece: str) -> bytes:
    """A piece in UTF-8 with spaces for the marks of word starts; <0xHH> is the byte HH."""
    if m := _BYTE.fullmatch(piece):
        return bytes([int(m[1], 16)])
    return piece.replace("▁", " ").encode()


class Aligner:
    """Two tokenizers and the bytes of their tokens."""

    def __init__(self, byte_blob: str, piece_blob: bytes):
        from sentencepiece import SentencePieceProcessor

        self.byte, self.piece = tokenizer(byte_blob, special=False), SentencePieceProcessor(model_proto=piece_blob)
        vocabulary = json.loads(byte_blob)["model"]["vocab"]
        self.a_bytes = [b""] * (1 + max(vocabulary.values()))
        for token, k in vocabulary.items():
            # special tokens stand beside the byte-level ones and are not made of them; no text gives one
            self.a_bytes[k] = byte_level(token) if all(c in _BYTE_OF for c in token) else token.encode()
        self.b_bytes = [piece_bytes(self.piece.id_to_piece(k)) for k in range(self.piece.get_piece_size())]
        if any("▁" in self.piece.id_to_piece(k).lstrip("▁") or b"\n" in b.strip(b"\n") for k, b in enumerate(self.b_bytes)):
            raise ValueError("a piece crosses the start of a word")
        self.a_len, self.b_len = (np.array([len(b) for b in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.n_b = len(self.b_bytes)
        self.space = self.piece.piece_to_id("▁")
        decimal = [b"%d" % k for k in range(max(len(self.a_bytes), self.n_b))]
        self.shown = np.array([[d + s for d in decimal] for s in (b",", b"|", b";")], dtype=object)
        self.cache = ChunkCache(self.aligned)

    def pieces_of(self, chunks: list[str]) -> list[list[int]]:
        """Ids of texts without the mark that the tokenizer puts before every text: a leading space is that mark."""
        coded = self.piece.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        return [([self.space] if c == " " else ids) if c[0] == " " else ids[1:] if ids[:1] == [self.space] else [] for c, ids in zip(chunks, coded, strict=True)]

    def aligned(self, chunks: list[str]) -> list[tuple | None]:
        """Of each chunk n_a, n_b, n_groups, its groups as text, its linked id pairs (a * size of B + b) as little-endian int64; None where bytes differ."""
        a = [e.ids for e in self.byte.encode_batch_fast(chunks, add_special_tokens=False)]
        b = self.pieces_of(chunks)
        same = [b"".join(map(self.a_bytes.__getitem__, x)) == c.encode() == b"".join(map(self.b_bytes.__getitem__, y)) for c, x, y in zip(chunks, a, b, strict=True)]
        n_a, n_b = (np.array([len(x) for x, ok in zip(side, same, strict=True) if ok], np.int64) for side in (a, b))
        if not n_a.sum():
            return [None] * len(chunks)
        ids_a, ids_b = (np.array([k for x, ok in zip(side, same, strict=True) if ok for k in x], np.int64) for side in (a, b))
        groups, links_a, links_b = coalesce(np.cumsum(self.a_len[ids_a]), self.a_len[ids_a], np.cumsum(self.b_len[ids_b]), self.b_len[ids_b])
        at_a, at_b = np.cumsum(n_a), np.cumsum(n_b)
        # of the tokens in order of group, side and place: what stands after each
        group = np.concatenate(groups)
        side = np.repeat([0, 1], [len(ids_a), len(ids_b)])
        order = np.lexsort((side, group))  # stable, so places stay in order
        group, side = group[order], side[order]
        more, turn = group[1:] == group[:-1], side[1:] != side[:-1]
        after = np.append(np.where(more, np.where(turn, 1, 0), 2), 2)
        shown = self.shown[after, np.concatenate([ids_a, ids_b])[order]].tolist()
        pairs = (ids_a[links_a] * self.n_b + ids_b[links_b]).astype("<i8")
        upto = np.searchsorted(links_a, at_a)  # links come by place of their A token
        n_groups = np.diff(groups[0][at_a - 1] + 1, prepend=0)
        ends = at_a + at_b
        out, k, s, p = [], 0, 0, 0
        for ok in same:
            if not ok:
                out.append(None)
                continue
            out.append((int(n_a[k]), int(n_b[k]), int(n_groups[k]), b"".join(shown[s : ends[k]]), pairs[p : upto[k]].tobytes()))
            s, p, k = ends[k], upto[k], k + 1
        return out

    def text(self, known: dict[str, tuple | None], chunks: list[str]) -> tuple[int, int, int, bytes, bytes]:
        """n_a, n_b, n_groups, groups and pairs of a text of these chunks."""
        parts = list(map(known.__getitem__, chunks))
        if not parts or None in parts:
            return 0, 0, 0, b"", b""
        n_a, n_b, n_groups, shown, pairs = zip(*parts, strict=True)
        return sum(n_a), sum(n_b), sum(n_groups), b"".join(shown)[:-1], b"".join(pairs)


def coalesce(a_end: np.ndarray, a_len: np.ndarray, b_end: np.ndarray, b_len: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """Groups of the tokens of both sides, and the links: places of A and of B whose ranges overlap, by A's place. Ends ascend."""
    start, end = np.concatenate([a_end - a_len, b_end - b_len]), np.concatenate([a_end, b_end])
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    group = np.empty(len(order), np.int64)
    group[order] = np.concatenate([[0], np.cumsum(start[order][1:] >= reach[:-1])])
    first = np.searchsorted(b_end, a_end - a_len, "right")
    count = np.searchsorted(b_end - b_len, a_end, "left") - first
    links_a = np.repeat(np.arange(len(a_end)), count)
    links_b = np.arange(len(links_a)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    return (group[: len(a_end)], group[len(a_end) :]), links_a, links_b


@functools.lru_cache(maxsize=1)
def _aligner(byte_blob: str, piece_blob: bytes) -> Aligner:
    return Aligner(byte_blob, piece_blob)


def _lists(counts: list[int], values: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, kind))


def links(docs: DataFrame, byte_path: str, piece_path: str, *, id_col: str = "doc_id", text_col: str = "text", groups: bool = False) -> DataFrame:
    """For every row: row (a number of its own), id_col, n_a, n_b, n_groups, n_links, groups_sha256, pairs (a * size of B + b, each once) and occurrences,
    both arrays[, groups string]."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(byte_path, encoding="utf-8") as f:
        byte_blob = spark.sparkContext.broadcast(f.read())
    with open(piece_path, "rb") as f:
        piece_blob = spark.sparkContext.broadcast(f.read())
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    aligner = Aligner(byte_blob.value, piece_blob.value)
    kind, narrow = ("int", pa.int32()) if len(aligner.a_bytes) * aligner.n_b < 1 << 31 else ("long", pa.int64())
    schema = f"row long, id {slim.schema['id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<{kind}>, occurrences array<int>"
    del aligner
    names = [c.split()[0] for c in schema.split(", ")] + ["groups"] * groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, row = _aligner(byte_blob.value, piece_blob.value), TaskContext.get().partitionId() << 33
        for batch in batches:
            chunks = [_PIECES(" " + t) if t else [] for t in batch.column(1).to_pylist()]
            known = aligner.cache.of({c for cs in chunks for c in cs})
            found = [aligner.text(known, cs) for cs in chunks]
            each = [np.unique(np.frombuffer(f[4], "<i8"), return_counts=True) for f in found]
            sizes = [len(p) for p, _ in each]
            cols = [pa.array(range(row, row + len(found)), pa.int64()), batch.column(0), *(pa.array([f[k] for f in found], pa.int64()) for k in range(3))]
            cols.append(pa.array([len(f[4]) // 8 for f in found], pa.int64()))
            cols.append(pa.array([hashlib.sha256(f[3]).hexdigest() if f[0] else "" for f in found], pa.string()))
            cols += [_lists(sizes, np.concatenate([np.zeros(0, np.int64), *(e[k] for e in each)]), t) for k, t in ((0, narrow), (1, pa.int32()))]
            if groups:
                cols.append(pa.array([f[3].decode() for f in found], pa.string()))
            row += len(found)
            yield pa.RecordBatch.from_arrays(cols, names)

    return slim.mapInArrow(run, schema + ", groups string" * groups).withColumnRenamed("id", id_col)


def pair_counts(linked: DataFrame, n_b: int) -> DataFrame:
    """pair, a, b, n_docs, best: documents that hold each pair linked, and whether no pair of its A id is in more."""
    counts = linked.select(F.explode("pairs").alias("pair")).select(F.col("pair").cast("long").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n_docs"))
    counts = counts.select("pair", F.expr(f"pair div {n_b}").alias("a"), (F.col("pair") % n_b).alias("b"), "n_docs")
    counts = cut(counts)
    # a row for each id of A, so no more than it has tokens
    most = counts.groupBy("a").agg(F.max("n_docs").alias("most"))
    return counts.join(F.broadcast(most), "a").select("pair", "a", "b", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def _head(counts: DataFrame, most: int) -> int:
    """The least power of two such that at most ``most`` pairs are in so many documents or more."""
    sizes = {r.k: r.n for r in counts.groupBy(F.floor(F.log2("n_docs")).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total, k = 0, 63
    while k > 0 and total + sizes.get(k - 1, 0) <= most:
        k -= 1
        total += sizes.get(k, 0)
    return 1 << k


def align(docs: DataFrame, byte_path: str, piece_path: str, *, head: int = HEAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: id_col, n_a, n_b, n_groups, n_links, n_best (links whose pair is in as many documents as any pair of its A id),
    count_sum (documents of the pair, summed over the links), groups_sha256."""
    from sentencepiece import SentencePieceProcessor

    spark = docs.sparkSession
    linked = cut(links(docs, byte_path, piece_path, id_col=id_col, text_col=text_col))
    counts = cut(pair_counts(linked, SentencePieceProcessor(model_file=piece_path).get_piece_size()))
    least = _head(counts, head)
    rows = counts.where(F.col("n_docs") >= least).select("pair", F.when(F.col("best"), F.col("n_docs")).otherwise(-F.col("n_docs")).alias("n")).toArrow()
    order = np.argsort(keys := rows.column("pair").to_numpy())
    sent = spark.sparkContext.broadcast((keys[order], rows.column("n").to_numpy()[order]))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counted = sent.value
        for batch in batches:
            pairs, times = (batch.column(k).flatten().to_numpy() for k in (1, 2))
            ends = np.concatenate([[0], np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False))])
            at = np.minimum(np.searchsorted(keys, pairs), max(0, len(keys) - 1))
            hit = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            n = np.where(hit, counted[at], 0) if len(keys) else np.zeros(len(pairs), np.int64)
            summed = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(summed(np.abs(n) * times)), pa.array(summed((n > 0) * times)), _lists(summed(~hit), pairs[~hit], pa.int64()), _lists(summed(~hit), times[~hit], pa.int64())],
                ["row", "s", "t", "pairs", "occurrences"],
            )

    looked = linked.select("row", "pairs", "occurrences").mapInArrow(look_up, "row long, s long, t long, pairs array<long>, occurrences array<long>")
    shown = [c for c in linked.columns if c not in ("row", "pairs", "occurrences")]
    if least > 1:
        looked = cut(looked)
        rest = looked.select("row", F.explode(F.arrays_zip("pairs", "occurrences")).alias("l")).select("row", F.col("l.pairs").alias("pair"), "l.occurrences")
        rare = rest.join(counts.where(F.col("n_docs") < least).select("pair", "n_docs", "best"), "pair")
        more = rare.select("row", (F.col("n_docs") * F.col("occurrences")).alias("s"), (F.col("best").cast("long") * F.col("occurrences")).alias("t"))
        looked = looked.select("row", "s", "t").unionByName(more)
    sums = looked.groupBy("row").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    return linked.join(sums, "row").select(*shown[:-1], F.col("t").alias("n_best"), F.col("s").alias("count_sum"), shown[-1])
