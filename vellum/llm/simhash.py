"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint sums the signs of the XXH64 values (seed 42) of a text's word shingles, repeats included. Two fingerprints
within ``radius`` bits of each other share at least one variant within radius/2 bits of both, so every distinct
fingerprint emits all its variants within half the radius, the shuffle meets on variants, and the pairs that collide
are verified by counting bits. A variant has a bounded number of distinct fingerprints around it (65 for radius 2), so no
group grows with the data: equal fingerprints are one row before the shuffle, however many documents carry them.

Defined results: words are runs without ASCII white space, A-Z lower-cased; a text of fewer words than a shingle is one
shingle; a null, empty or blank text has fingerprint zero, linked like any other; every row comes back, repeated rows too.

``verified_classes`` is the near-dedup of the pipeline. Links of whole fingerprints are few and may be wrong, so there they are
candidates only, beside texts that share the fingerprint of one of ``BANDS`` shingle subsets, each the least shingles under
``ROWS`` orders; what meets is verified by the exact Jaccard similarity of the sets of shingles.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from vellum.llm.common import bounded, components, cut, small_batches

SEED = 42

#: At similarity 0.8 a pair shares no subset of four orders in twenty with probability (1 - 0.8^4)^20 = 0.00003.
BANDS, ROWS = 20, 4
#: A tile holds about so many texts of a subset's group, or so many bytes of them, against as many others.
TILE, TILE_BYTES = 512, 8 << 20
_ORDERS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """The XXH64 values of a text's word shingles, repeats included; none for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-shingle]]).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))


def _majority(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        set_bits += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint of one text; a bit is 1 if it is set in over half the shingles' hashes."""
    return _majority(shingles(text, shingle))


def fingerprints(docs: DataFrame, *, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and fp long (the fingerprint's 64 bits) for every row."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, fp long").withColumnRenamed("id", id_col)


def ball_masks(half: int) -> list[int]:
    """All 64-bit masks of at most ``half`` bits, as signed integers."""
    out = [0]
    for k in range(1, half + 1):
        out += [sum(1 << b for b in bits) for bits in combinations(range(64), k)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Pairs u < v of distinct fingerprints (column fp) within ``radius`` bits whose stars span every such pair.

    Of the fingerprints around a variant, each is paired with the smallest one; where that pair is further apart than
    the radius (odd radii only), all pairs around the variant, a bounded number, are verified instead.
    """
    # dealt out, since adaptive execution would read the few bytes of the fingerprints in a task or two and grow them there
    distinct = fps.select("fp").distinct().repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    masks = F.array(*[F.lit(m).cast("long") for m in ball_masks(-(-radius // 2))])
    met = (
        distinct.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
        .groupBy("variant")
        .agg(F.sort_array(F.collect_set("fp")).alias("around"))
        .where(F.size("around") > 1)
    )
    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= radius
    if radius % 2 == 0:
        pairs = met.select(F.col("around")[0].alias("u"), F.explode(F.slice("around", 2, 1 << 20)).alias("v"))
    else:
        pairs = met.select(F.explode("around").alias("u"), "around").select("u", F.explode("around").alias("v")).where("u < v")
    return pairs.distinct().where(near(F.col("u"), F.col("v")))


def classes(docs: DataFrame, *, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fp, component: the smallest id reachable over links, for every row."""
    fps = cut(fingerprints(docs, shingle=shingle, id_col=id_col, text_col=text_col))
    least = cut(fps.groupBy("fp").agg(F.min(id_col).alias("least")))
    member = components(links(least, radius))
    linked = member.join(least.withColumnRenamed("fp", "node"), "node")
    lowest = linked.groupBy("root").agg(F.min("least").alias("lowest"))
    by_fp = linked.join(lowest, "root").select(F.col("node").alias("fp"), "lowest")
    known = least.join(by_fp, "fp", "left").select("fp", F.coalesce("lowest", "least").alias("component"))
    return fps.join(known, "fp").select(id_col, "fp", "component")


def subsets(hashes: np.ndarray) -> list[int]:
    """Fingerprints (signed) of BANDS subsets of a text's shingles: the least under each of ROWS orders."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    flip, factor = _ORDERS
    for at in range(0, len(hashes), 2048):
        np.minimum(least, ((hashes[None, at : at + 2048] ^ flip) * (factor | np.uint64(1))).min(axis=1), out=least)
    raw, width = least.tobytes(), 8 * ROWS
    found = [xxhash.xxh64_intdigest(raw[k * width : (k + 1) * width], k) for k in range(BANDS)]
    return [x - (1 << 64) if x >> 63 else x for x in found]


def _shingle_set(text: str, shingle: int) -> set[bytes]:
    words = text.encode().lower().split()
    return {b" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))}


def _similar(p: set[bytes], q: set[bytes], similarity: float) -> bool:
    both = len(p & q)
    return both >= similarity * (len(p) + len(q) - both) - 1e-9


def texts_of(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """key, text: the texts of ``docs`` that stand in ``pairs`` (u, v: keys), one row each, in the checkpoint folder."""
    ids = pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct()
    return cut(docs.join(bounded(ids, 2_000_000), "key").groupBy("key").agg(F.first("text").alias("text")))


def verified(texts: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (u, v: keys of ``texts``) whose sets of shingles have the Jaccard similarity or more."""
    small_batches(texts.sparkSession)
    a = texts.select(F.col("key").alias("u"), F.col("text").alias("a"))
    b = texts.select(F.col("key").alias("v"), F.col("text").alias("b"))

    def run(batches):
        for batch in batches:
            left, held, keep = {}, 0, []  # sets of the texts u, some MB of text at a time
            us, vs, lefts, rights = (batch.column(n) for n in ("u", "v", "a", "b"))
            for u, x, y in zip(us.to_pylist(), lefts, rights, strict=True):
                if u not in left:
                    text = x.as_py()
                    held += len(text)
                    if held > 1 << 20:
                        left, held = {}, len(text)
                    left[u] = _shingle_set(text, shingle)
                keep.append(_similar(left[u], _shingle_set(y.as_py(), shingle), similarity))
            yield pa.RecordBatch.from_arrays([us, vs], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return cut(pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long"))


def _tile_links(part: pd.DataFrame, shingle: int, similarity: float) -> pd.DataFrame:
    """The components (u, v: roots) that one tile's links join, left texts to right ones, as a forest.

    The texts' hashes find a link, their shingles themselves confirm it.
    """
    sides = [part[part["left"]], part[~part["left"]]]
    hashes = [[np.unique(shingles(t, shingle)) for t in side["text"]] for side in sides]
    sizes = [np.array([len(h) for h in side], np.float64) for side in hashes]
    common = np.intersect1d(*[np.concatenate([*side, np.zeros(0, np.uint64)]) for side in hashes])
    both = np.zeros((len(sides[0]), len(sides[1])), np.float32)
    for at in range(0, len(common), 4096):
        some = common[at : at + 4096]
        marks = []
        for side in hashes:
            mark = np.zeros((len(side), len(some)), np.float32)
            for row, h in zip(mark, side, strict=True):
                row[np.isin(some, h, assume_unique=True)] = 1
            marks.append(mark)
        both += marks[0] @ marks[1].T
    near = both >= similarity * (sizes[0][:, None] + sizes[1][None, :] - both) - 1e-9
    (lefts, uroots), (rights, vroots) = [(side["text"].tolist(), side["root"].tolist()) for side in sides]
    parent, found = {}, []

    def top(x):
        while x in parent:
            x = parent[x]
        return x

    for i, j in np.argwhere(near).tolist():
        x, y = top(uroots[i]), top(vroots[j])
        if x != y and _similar(_shingle_set(lefts[i], shingle), _shingle_set(rights[j], shingle), similarity):
            parent[max(x, y)] = min(x, y)
            found.append((x, y))
    return pd.DataFrame(found, columns=["u", "v"], dtype="int64")


def tiled_links(texts: DataFrame, held: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Pairs of roots (u, v) that join all components within the groups: texts key, text; ``held`` band, key, size (bytes), root.

    Texts outside a group's largest component are held against all of the group. Both sides are dealt into blocks and every pair of
    blocks is a tile of bounded size, so a group takes many tasks and its texts travel once a tile, not once a pair.
    """
    sizes = held.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    blocks = lambda n, size: F.greatest(F.ceil(n / TILE), F.ceil(size / TILE_BYTES), F.lit(1)).cast("int")
    order = F.struct("n", "root")
    mixed = (
        sizes.groupBy("band")
        .agg(F.max_by("root", order).alias("major"), F.max_by("size", order).alias("s"), F.max("n").alias("m"), F.sum("n").alias("n"), F.sum("size").alias("size"))
        .where("n > m")
        .select("band", "major", blocks(F.col("n") - F.col("m"), F.col("size") - F.col("s")).alias("xs"), blocks(F.col("n"), F.col("size")).alias("ys"))
    )
    open_ = held.join(mixed, "band").withColumn("h", F.xxhash64("key", "band"))
    one = lambda n: F.pmod("h", n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = open_.where("root <> major").select("band", "key", "root", F.lit(True).alias("left"), one(F.col("xs")).alias("x"), every("ys").alias("y"))
    right = open_.select("band", "key", "root", F.lit(False).alias("left"), every("xs").alias("x"), one(F.col("ys")).alias("y"))
    tiles = left.unionByName(right).join(texts, "key").groupBy("band", "x", "y")
    return tiles.applyInPandas(lambda part: _tile_links(part, shingle, similarity), "u long, v long")


def verified_classes(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, component: the smallest id reachable over verified pairs, for every row.

    First every text of a subset's group is held against the group's smallest. Where a group then has texts of several components,
    tiles hold each text outside the group's largest component against all of the group (``tiled_links``), and what they join are
    components, not texts again. Every pair of a group is so compared or linked. Texts that meet any other are stored once for both.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"), F.octet_length(text).cast("long").alias("size"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                hashes = [shingles(t.as_py(), shingle) for t in part.column(2)]
                fps = np.array([_majority(h) for h in hashes], np.uint64).view(np.int64)
                bands = pa.array([subsets(h) for h in hashes], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array(fps), bands], ["id", "key", "size", "fp", "bands"])

    kind = slim.schema["id"].dataType.simpleString()
    signed = cut(slim.mapInArrow(run, f"id {kind}, key long, size long, fp long, bands array<bigint>"))
    nodes = cut(signed.groupBy("key").agg(F.min("id").alias("least"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    groups = nodes.select("key", "size", F.explode("bands").alias("band"))
    several = groups.groupBy("band").agg(F.min("key").alias("u"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "u")
    shared = cut(groups.join(several, "band"))
    by_fp = nodes.groupBy("fp").agg(F.min("key").alias("first"))
    near = links(by_fp, radius)
    u, v = by_fp.select(F.col("fp").alias("u"), F.col("first").alias("x")), by_fp.select(F.col("fp").alias("v"), F.col("first").alias("y"))
    stars = [
        shared.select("u", F.col("key").alias("v")),
        nodes.join(by_fp, "fp").select(F.col("first").alias("u"), F.col("key").alias("v")),
        near.join(u, "u").join(v, "v").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")),
    ]
    tried = cut(stars[0].unionByName(stars[1]).unionByName(stars[2]).where("u <> v").distinct())
    texts = texts_of(slim, tried)
    member = components(verified(texts, tried, shingle, similarity)).withColumnRenamed("node", "key")
    held = shared.drop("u").join(member, "key", "left").withColumn("root", F.coalesce("root", "key"))
    joined = components(tiled_links(texts, held, shingle, similarity)).select(F.col("node").alias("root"), F.col("root").alias("top"))
    rooted = nodes.join(member, "key", "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    rooted = rooted.join(joined, "root", "left").select("key", "least", F.coalesce("top", "root").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    known = rooted.join(lowest, "root").select("key", "component")
    return signed.select("id", "key").join(known, "key").select(F.col("id").alias(id_col), "component")
