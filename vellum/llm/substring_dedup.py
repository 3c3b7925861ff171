"""Substring dedup: words of windows that occur more than once are removed, found by an FM-index for each shard.

Sharding: each window of ``window`` words has one anchor, the leftmost of its ``gram``-word runs with the least hash, so
equal windows have equal anchors and meet in one shard. Anchors that occur once in the corpus cannot lie in a repeated
window and go no further. Around each other anchor, the words of the windows that chose it form a segment; segments go to
the shard of their anchor, which stores equal ones once with their number, builds a compressed FM-index (a wavelet matrix
of the Burrows-Wheeler transform) over them, and streams every segment through it by backward search. The matching
statistics reach ``window`` exactly where a window is repeated. Of a segment's places in one task all beyond the second are
repeated without a search. A task builds one index after another, each of some
100,000 words or one anchor's segments. Windows of an anchor that over ``hot`` texts hold are sharded by the whole
window instead, so no index grows with a common passage.

Equal texts are one row up to the last join; a text that stands in several rows is repeated as a whole. Word hashes
are 64-bit XXH64.

Defined results: a null text has no words and comes back as such with an empty kept text; texts shorter than a window keep
all words; kept words are joined by single spaces; repeated rows count as occurrences of each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from vellum.llm.common import small_batches
from vellum.llm.fm_index import repeated_windows

WINDOW, GRAM, HOT, SHARD_WORDS = 35, 12, 5_000, 150_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def gram_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Mixed polynomial hashes of all runs of ``size`` words, built up by doubling."""
    with np.errstate(over="ignore"):
        out, have, base = None, 0, _ODD
        part, length = h, 1
        left = size
        while left:
            if left & 1:
                out, have = (part, length) if out is None else (out[: len(h) - have - length + 1] * base + part[have : len(h) - length + 1], have + length)
            left >>= 1
            if left:
                part = part[:-length] * base + part[length:]
                length, base = 2 * length, base * base
        return _mix(out)


def anchors(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a text's word hashes: anchor hash, first window and number of windows of every anchor occurrence."""
    if len(h) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = gram_hashes(h, gram)
    at = np.lib.stride_tricks.sliding_window_view(g, window - gram + 1).argmin(axis=1) + np.arange(len(h) - window + 1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return g[at[first]], first, np.diff(np.concatenate([first, [len(at)]]))


def _anchor_rows(batches, window, gram):
    for b in batches:
        th, tg, a, n = [], [], [], []
        for k, text in enumerate(b.column(2).to_pylist()):
            u, c = np.unique(anchors(word_hashes(text.encode().split()), window, gram)[0], return_counts=True)
            a.append(u.view(np.int64))
            n.append(np.minimum(c, 2))
            th.append(np.full(len(u), k))
        if a:
            row = pa.array(np.concatenate(th))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(row), b.column(1).take(row), pa.array(np.concatenate(a)), pa.array(np.concatenate(n).astype(np.int64))], ["th", "tg", "a", "n"]
            )


_ROW = "th long, tg long, start int, n int, a long, s long, has boolean, words binary"


def _segment_rows(batches, window, gram):
    """Segments of the repeated anchors of each text; words are left out where this task gave the segment before.

    Of a segment's places in one task the first two go to its shard, which then knows it as repeated. All further ones are
    repeated as well; they go anywhere (dealt by their text, has null), so no shard grows with a passage's copies.
    """
    seen: dict[int, bool] = {}  # whether the shard has two places of a segment
    for b in batches:
        for k in range(b.num_rows):
            th, tg, text, want, hot = (b.column(i)[k].as_py() for i in range(5))
            h = word_hashes(text.encode().split())
            a, first, count = anchors(h, window, gram)
            pick = np.flatnonzero(np.isin(a.view(np.int64), np.array(want, np.int64)))
            single = np.isin(a[pick].view(np.int64), np.array(hot or [], np.int64))
            out = ([], [], [], [], [], [])
            for i, alone in zip(pick.tolist(), single.tolist(), strict=True):
                spans = [(s, 1) for s in range(first[i], first[i] + count[i])] if alone else [(int(first[i]), int(count[i]))]
                for s, n in spans:
                    raw = h[s : s + n + window - 1].tobytes()
                    key = xxhash.xxh64_intdigest(raw, 1)
                    new, known = key not in seen, seen.get(key, False)
                    if len(seen) > 500_000:
                        seen.clear()
                    seen[key] = not new
                    key = key - (1 << 64) if key >> 63 else key
                    anchor = key if alone else int(a[i].view(np.int64))
                    row = (s, n, th, th, None, None) if known else (s, n, anchor, key, new, raw if new else None)
                    for col, x in zip(out, row, strict=True):
                        col.append(x)
            size = len(out[0])
            if size:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([th] * size, pa.int64()), pa.array([tg] * size, pa.int64()), pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32())]
                    + [pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.bool_()), pa.array(out[5], pa.binary())],
                    ["th", "tg", "start", "n", "a", "s", "has", "words"],
                )


def _shard_rows(batches, window, shard_words):
    """From rows sorted by anchor, segment and has (descending): th, tg and the starts of repeated windows."""
    names = ["th", "tg", "starts"]

    def rows(got):
        if got:
            th, tg, starts = zip(*got, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(th, pa.int64()), pa.array(tg, pa.int64()), pa.array(starts, pa.list_(pa.int32()))], names)

    def search(shard):
        if not shard:
            return []
        words, inverse = np.unique(np.concatenate([np.frombuffer(x[3], np.uint64) for x in shard]), return_inverse=True)
        ends = np.cumsum([len(x[3]) // 8 for x in shard])
        parts = np.split(inverse.astype(np.int64) + 1, ends[:-1])
        found = repeated_windows(parts, np.array([x[4] for x in shard]), window)
        return [(x[0], x[1], (f + x[2]).astype(np.int32)) for x, f in zip(shard, found, strict=True) if len(f)]

    shard: list = []  # [th, tg, start, words, number] of the first place of each distinct segment
    size, anchor, segment = 0, None, None
    for b in batches:
        got = []
        th, tg, start, n, a, s = (b.column(i).to_pylist() for i in range(6))
        has, words = b.column(6).to_pylist(), b.column(7)
        for k in range(b.num_rows):
            if has[k] is None:
                got.append((th[k], tg[k], np.arange(start[k], start[k] + n[k], dtype=np.int32)))
                if len(got) >= 20_000:
                    yield from rows(got)
                    got = []
                continue
            if a[k] != anchor:
                if size >= shard_words:
                    got += search(shard)
                    shard, size = [], 0
                anchor, segment = a[k], None
            if s[k] != segment:
                segment = s[k]
                shard.append([th[k], tg[k], start[k], words[k].as_py(), 1])
                size += len(shard[-1][3]) // 8
            else:  # a further place of a segment that is in the index: it repeats as the first place does
                shard[-1][4] = 2
                got.append((th[k], tg[k], np.arange(start[k], start[k] + n[k], dtype=np.int32)))
            if len(got) >= 20_000:
                yield from rows(got)
                got = []
        yield from rows(got)
    yield from rows(search(shard))


def _kept_rows(batches, window):
    for b in batches:
        out = ([], [], [])
        for text, copies, starts in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
            words = text.encode().split()
            n = len(words)
            gone = np.zeros(n + 1, np.int64)
            if copies > 1 and n >= window:
                gone[0] = 1
            elif starts:
                at = np.unique(np.array(starts, np.int64))
                np.add.at(gone, at, 1)
                np.add.at(gone, at + window, -1)
            stay = np.flatnonzero(np.cumsum(gone)[:n] == 0)
            out[0].append(n)
            out[1].append(n - len(stay))
            out[2].append(b" ".join([words[i] for i in stay.tolist()] if len(stay) < n else words))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["th", "tg", "n_words", "n_removed", "kept"]
        )


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, shard_words: int = SHARD_WORDS, id_col: str = "doc_id", text_col: str = "text", derive: dict[str, Column] | None = None) -> DataFrame:
    """id_col, n_words, n_removed (long) and kept (binary: the kept words, UTF-8) for every row of ``docs``.

    derive: columns to have in place of kept, worked out of it once for each distinct text, before rows of equal texts take them.
    """
    small_batches(docs.sparkSession)
    derive = derive or {"kept": F.col("kept")}
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_col), text.alias("text")).select(id_col, "text", F.xxhash64("text").alias("th"), F.xxhash64("text", F.lit(1)).alias("tg"))
    texts = slim.groupBy("th", "tg").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    # Both uses of the texts' and of the anchors' shuffles read the same columns, so that Spark writes each once.
    held = texts.select("th", "tg", "text", "copies").mapInArrow(lambda b: _anchor_rows(b, window, gram), "th long, tg long, a long, n long").repartition("a")
    often = held.groupBy("a").agg(F.sum("n").alias("places"), F.max("th").alias("t1"), F.max("tg").alias("t2")).where("places > 1 or t1 is null or t2 is null")
    some = F.when(F.col("n") > 0, F.col("a"))
    wanted = (
        held.join(often.select("a", "places"), "a")
        .groupBy("th", "tg")
        .agg(F.collect_list(some).alias("want"), F.collect_list(F.when(F.col("places") > hot, some)).alias("hot"))
    )
    segments = texts.join(wanted, ["th", "tg"]).select("th", "tg", "text", "want", "hot", "copies").mapInArrow(lambda b: _segment_rows(b, window, gram), _ROW)
    sharded = segments.repartition("a").sortWithinPartitions("a", "s", F.desc("has"))
    repeated = sharded.mapInArrow(lambda b: _shard_rows(b, window, shard_words), "th long, tg long, starts array<int>")
    starts = repeated.groupBy("th", "tg").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    kept = (
        texts.join(starts, ["th", "tg"], "left")
        .select("th", "tg", "text", "copies", "starts")
        .mapInArrow(lambda b: _kept_rows(b, window), "th long, tg long, n_words long, n_removed long, kept binary")
    )
    kept = kept.select("th", "tg", "n_words", "n_removed", *[c.alias(name) for name, c in derive.items()])
    return slim.select(id_col, "th", "tg").join(kept, ["th", "tg"]).select(id_col, "n_words", "n_removed", *derive)
