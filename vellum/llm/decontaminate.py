"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

Every item gives windows of ``window`` consecutive words (a shorter item is one window). A document that holds a window
holds all its words, so its rarest word, by corpus count, is prefix enough: documents join windows on that word alone.
The word's place in the window gives the place where the window would start; candidates that start before the
document's first word or end after its last are dropped, and the rest are verified word by word in the document.

Corpus counts are taken of the items' words only. Items and counts are broadcast if their rows stay under ``BOUND``; beyond
it the joins shuffle.

Defined results: null, empty and wordless texts have no words, so no hits; wordless items have no windows; equal windows
of several items count for each; repeated documents each come back; an item id that is null is left out of the lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vellum.llm.common import bounded, cut

BOUND = 200_000
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _LOWER))


def words(c: Column) -> Column:
    """Words of ASCII letters, digits and all beyond ASCII, in their own case (no words for null)."""
    return F.coalesce(F.array_remove(F.split(c, _GAP), ""), F.array().cast("array<string>"))


def windows(items: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """Distinct windows: win (its words joined by a space), size, items (sorted ids as strings)."""
    w = items.select(F.col(item_col).cast("string").alias("item"), F.split(lower_ascii(F.array_join(words(F.col(text_col).cast("string")), " ")), " ").alias("w"))
    w = w.where(F.col("w")[0] != "")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return (
        w.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("part"))
        .groupBy(F.array_join("part", " ").alias("win"), F.size("part").alias("size"))
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )


def contained(docs: DataFrame, items: DataFrame, *, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """All columns of ``docs`` and n_words, n_hit, n_items (long), items array<string>, spans array<struct<start,size>>.

    A word is hit if it lies inside any occurrence of a window; items has those with occurring windows. Columns of ``docs`` of
    these five names are left out.
    """
    docs = docs.drop("n_words", "n_hit", "n_items", "items", "spans")
    win = cut(windows(items, window, item_col, "text"))
    each = win.select("win", "size", F.posexplode(F.split("win", " ")).alias("off", "word"))
    vocabulary = bounded(cut(each.select("word").distinct()), BOUND)
    text = F.col(text_col).cast("string")
    counts = (
        docs.select(F.explode(words(text)).alias("word")).select(lower_ascii(F.col("word")).alias("word")).join(vocabulary, "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    )
    rarest = (
        each.join(counts, "word", "left")
        .groupBy("win", "size")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "off")).alias("p"))
        .where("p.n > 0")  # a window with a word that no document has occurs nowhere
    )
    prefix = cut(rarest.join(win.select("win", "items"), "win").select(F.col("p.word").alias("word"), F.col("p.off").alias("off"), "win", "size", "items"))
    row = F.struct(F.xxhash64(F.col(id_col), text).alias("a"), F.xxhash64(F.lit(1), text, F.col(id_col)).alias("b"))  # 128 bits tell rows apart
    d = docs.select(row.alias("doc__"), words(text).alias("w"))
    found = (
        d.select("doc__", F.size("w").alias("n"), F.posexplode("w").alias("pos", "word"))
        .select("doc__", "n", "pos", lower_ascii(F.col("word")).alias("word"))
        .join(bounded(prefix, BOUND), "word")
        .select("doc__", (F.col("pos") - F.col("off")).alias("start"), "n", "win", "size", "items")
        .where("start >= 0 and start + size <= n")
        .groupBy("doc__")
        .agg(F.collect_set(F.struct("start", "size", "win", "items")).alias("met__"))
    )
    joined = docs.withColumn("doc__", row).join(found, "doc__", "left").drop("doc__")
    none = F.array().cast(found.schema["met__"].dataType)

    def verified(x: Column) -> Column:
        same = lambda c: lower_ascii(F.array_join(F.slice(x["w"], c["start"] + 1, c["size"]), " ")) == c["win"]
        return F.struct(F.size(x["w"]).cast("long").alias("n"), F.coalesce(F.filter(x["met"], same), none).alias("hits"))

    # transform binds a text's words, so that they are split once; explode keeps a filter on the result above this work
    bound = F.transform(F.array(F.struct(words(text).alias("w"), F.col("met__").alias("met"))), verified)
    out = joined.select(*docs.columns, F.explode_outer(bound).alias("r__")).select(*docs.columns, F.col("r__.n").alias("n_words"), F.col("r__.hits").alias("hits__"))
    covered = F.array_distinct(F.flatten(F.transform("hits__", lambda h: F.sequence(h["start"], h["start"] + h["size"] - 1))))
    ids = F.array_sort(F.array_distinct(F.flatten(F.col("hits__.items"))))
    out = out.withColumn("items", ids).withColumn("n_hit", F.size(covered).cast("long"))
    spans = F.array_sort(F.array_distinct(F.transform("hits__", lambda h: F.struct(h["start"].alias("start"), h["size"].alias("size")))))
    return out.select(*docs.columns, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", spans.alias("spans"))


def contaminated() -> Column:
    """The rule: at least a twentieth of the words are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
