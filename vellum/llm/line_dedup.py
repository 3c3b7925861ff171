"""Line dedup by a segment-partition edit join, in DataFrame operations only.

A line is removed if an equal line, or one within ``threshold`` edits (insertion, deletion, substitution of a
character), stands earlier in the corpus: at a smaller (id, line number). Lines shorter than ``min_chars`` match only equal
lines; blank lines always stay.

Equal lines meet by hash (64-bit XXH64 with 32-bit Murmur3) under partial aggregation, so the edit join sees each distinct
line once. A line of length m is cut into threshold + 1 even segments; two lines within the threshold agree on a
whole segment, so every line is indexed under (length, segment number, segment) and probes, for each length up to
``threshold`` shorter, the substrings that multi-match-aware selection leaves. What meets is verified by a banded
bit-parallel edit distance: one machine word of 2 x threshold + 1 diagonals for each number of errors. An index entry that
over ``hot`` distinct lines share is not paired (threshold 1): its lines meet again on all variants of the rest of the line
with one character deleted, where each group holds only true links, at most one line for each letter.

Defined results: null texts have no lines and come back as null; an empty text is one blank line; repeated rows (same id,
same text) are one document, so both come back alike; a row without an id comes before all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vellum.llm.common import bounded, cut, unused

#: Distinct lines under one index entry beyond which deletion variants take the place of pairs.
HOT = 64


def within(a: Column, b: Column, threshold: int) -> Column:
    """True if the strings are within ``threshold`` edits: banded bit-parallel automaton over b's characters.

    Word r_e has bit d + threshold set while position (characters of a) = (characters of b) + d is reachable with at
    most e errors.
    """
    mask = (1 << (2 * threshold + 1)) - 1
    start = F.struct(*[F.lit(sum(1 << (threshold + d) for d in range(e + 1))).cast("int").alias(f"r{e}") for e in range(threshold + 1)])

    def verdict(x: Column) -> Column:
        p, t = x["p"], x["t"]
        n, m = F.size(t), F.size(p)

        def step(acc: Column, j: Column) -> Column:
            c = F.get(t, j)
            same = F.lit(0)
            for d in range(-threshold, threshold + 1):
                same = same.bitwiseOR(F.when(F.get(p, j + d) == c, 1 << (d + threshold)).otherwise(0))
            new: list[Column] = []
            for e in range(threshold + 1):
                r = acc[f"r{e}"].bitwiseAND(same)
                if e:
                    old = acc[f"r{e - 1}"]
                    r = r.bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(F.shiftleft(new[-1], 1))
                new.append(r.bitwiseAND(F.lit(mask)))
            return F.struct(*[r.cast("int").alias(f"r{e}") for e, r in enumerate(new)])

        steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        last = F.aggregate(steps, start, step)[f"r{threshold}"]
        end = F.get(F.array(*[F.lit(1 << k) for k in range(2 * threshold + 1)]), m - n + threshold)
        return F.coalesce(last.bitwiseAND(end) != 0, F.lit(False))

    # the one step of transform binds the characters, which every step of aggregate reads
    chars = lambda c: F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ""))
    both = F.array(F.struct(chars(a).alias("p"), chars(b).alias("t")))
    return (F.abs(F.length(a) - F.length(b)) <= threshold) & F.get(F.transform(both, verdict), 0)


def _segment(length: Column, j: int, threshold: int) -> tuple[Column, Column]:
    """Start (from 0) and length of the j-th of threshold + 1 even segments; the longer ones come last."""
    k = threshold + 1
    base, more = F.floor(length / k).cast("int"), length % k
    return F.lit(j) * base + F.greatest(F.lit(0), more - (k - j)), base + (more >= k - j).cast("int")


def _keys(line: Column, length: Column, threshold: int) -> tuple[list[Column], list[Column]]:
    """Index entries of a line, and its probes of shorter or shifted entries."""
    index, probes = [], []
    for j in range(threshold + 1):
        at, size = _segment(length, j, threshold)
        index.append(F.xxhash64(length, F.lit(j), F.substring(line, at + 1, size)))
        for shorter in range(threshold + 1):
            of = length - shorter
            at, size = _segment(of, j, threshold)
            low, high = max(-j, shorter - threshold + j), min(j, shorter + threshold - j)
            probes += [F.xxhash64(of, F.lit(j), F.substring(line, at + 1 + s, size)) for s in range(low, high + 1) if shorter or s]
    return index, probes


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc (hash of id and text), first (struct of id and line number), no, line, h, g of every line."""
    d = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    d = d.select("id", F.xxhash64("id", "text").alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))
    return d.select("doc", F.struct("id", "no").alias("first"), "no", "line", F.xxhash64("line").alias("h"), F.hash("line").alias("g"))


def near_earlier(docs: DataFrame, distinct: DataFrame, threshold: int, hot: int, id_col: str, text_col: str) -> DataFrame:
    """h of every distinct line that has an earlier, unequal line within the threshold."""
    k = threshold + 1
    rows = distinct.where(F.size("keys") > 0).select("h", "len", F.posexplode("keys").alias("at", "key"))
    index = rows.where(F.col("at") < k).select("key", "h", "len")
    counted = index.withColumn("n", F.expr("count(1) over (partition by key)"))
    right = rows.select("key", F.col("h").alias("rh"), F.col("len").alias("rlen"), (F.col("at") < k).alias("indexed"))
    meet = ((F.col("len") < F.col("rlen")) | (F.col("indexed") & (F.col("h") < F.col("rh")))) & (F.col("rlen") - F.col("len") <= threshold)
    few = counted.where(F.col("n") <= hot) if threshold == 1 else counted
    pairs = cut(few.join(right, "key").where(meet).select(F.col("h").alias("u"), F.col("rh").alias("v")).distinct())
    seen = lambda ids: (  # noqa: E731  text and first place of the lines asked for
        _lines(docs, id_col, text_col).join(bounded(ids, 2_000_000), "h").groupBy("h").agg(F.min("first").alias("first"), F.min("line").alias("line"))
    )
    ids = pairs.select(F.explode(F.array("u", "v")).alias("h")).distinct()
    known = cut(seen(ids))
    a = known.select(F.col("h").alias("u"), F.col("first").alias("fu"), F.col("line").alias("lu"))
    b = known.select(F.col("h").alias("v"), F.col("first").alias("fv"), F.col("line").alias("lv"))
    linked = pairs.join(a, "u").join(b, "v").where(within(F.col("lu"), F.col("lv"), threshold))
    later = linked.select(F.when(F.col("fu") < F.col("fv"), F.col("v")).otherwise(F.col("u")).alias("h"))
    if threshold != 1:
        return later.distinct()
    # threshold 1: the lines of hot entries share one half; the other half meets on its deletion variants
    many = cut(counted.where(F.col("n") > hot).select("key", "h", "len", F.lit(True).alias("indexed")))
    keys = many.select("key").distinct()
    probes = right.where(~F.col("indexed")).join(keys, "key", "left_semi").select("key", F.col("rh").alias("h"), F.col("rlen").alias("len"), "indexed")
    members = cut(many.unionByName(probes))
    lines = seen(members.select("h").distinct())
    half = F.floor((F.col("len") - (~F.col("indexed")).cast("int")) / 2).cast("int")  # of the entry's length
    # which half an entry is: the first one's hash is the entry's key
    first_half = F.xxhash64(F.col("len") - (~F.col("indexed")).cast("int"), F.lit(0), F.substring("line", F.lit(1), half)) == F.col("key")
    size = F.col("len") - (~F.col("indexed")).cast("int")
    shared_last = size - half
    rest = F.when(first_half, F.substring("line", half + 1, F.length("line"))).otherwise(F.substring("line", F.lit(1), F.length("line") - shared_last))
    m = members.join(lines, "h").select("key", "h", "first", "indexed", rest.alias("rest"))
    less = m.select("key", "h", "first", "indexed", "rest", F.explode(F.sequence(F.lit(1), F.greatest(F.length("rest"), F.lit(1)))).alias("i"))
    short = F.concat(F.expr("substring(rest, 1, i - 1)"), F.expr("substring(rest, i + 1)"))
    # indexed lines of one length differ in character i alone; a probing line less character i is an indexed line
    swap = less.where("indexed").select("key", F.xxhash64(F.lit("swap"), "i", short).alias("x"), "h", "first", F.lit(0).alias("side"))
    drop = less.where("not indexed").select("key", F.xxhash64(F.lit("drop"), F.lit(0), short).alias("x"), "h", "first", F.lit(1).alias("side"))
    whole = m.where("indexed").select("key", F.xxhash64(F.lit("drop"), F.lit(0), "rest").alias("x"), "h", "first", F.lit(2).alias("side"))
    met = cut(swap.unionByName(drop).unionByName(whole))
    least = met.groupBy("key", "x").agg(
        F.min(F.when(F.col("side") != 1, F.col("first"))).alias("indexed_first"), F.min(F.when(F.col("side") == 1, F.col("first"))).alias("probe_first")
    )
    other = F.when(F.col("side") == 0, F.col("indexed_first") < F.col("first")).when(F.col("side") == 1, F.col("indexed_first") < F.col("first")).otherwise(F.col("probe_first") < F.col("first"))
    return later.unionByName(met.join(least, ["key", "x"]).where(other).select("h")).distinct()


def dedup(docs: DataFrame, *, threshold: int = 1, min_chars: int = 10, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with text_col less its removed lines, and two more columns: n_lines, n_removed (long), in place of any of those names."""
    docs = docs.drop("n_lines", "n_removed")
    lines = _lines(docs, id_col, text_col)
    length = F.length("line")
    index, probes = _keys(F.col("line"), length, threshold)
    none = F.array().cast("array<bigint>")
    fuzzy = (length >= max(min_chars, 2 * (threshold + 1))) & (F.trim("line") != "")
    occur = lines.select("doc", "first", "no", "h", "g", length.alias("len"), F.when(fuzzy, F.array(*index, *probes)).otherwise(none).alias("keys"), (F.trim("line") == "").alias("blank"))
    occur = cut(occur)
    least = cut(
        occur.where(~F.col("blank")).groupBy("h", "g").agg(F.min("first").alias("least"), F.first("len").alias("len"), F.first("keys").alias("keys"))
    )
    gone = near_earlier(docs, least, threshold, hot, id_col, text_col).withColumn("near", F.lit(True))
    judged = least.select("h", "g", "least").join(gone, "h", "left")
    kept = (
        occur.select("doc", "first", "no", "h", "g", "blank")
        .join(judged, ["h", "g"], "left")
        .select("doc", "no", (F.col("blank") | ((F.col("first") == F.col("least")) & F.col("near").isNull())).alias("keep"))
    )
    doc, flags = unused(docs, "doc"), unused(docs, "flags")
    of = kept.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("no", "keep"))).alias(flags)).withColumnRenamed("doc", doc)
    out = docs.withColumn(doc, F.xxhash64(F.col(id_col), F.col(text_col).cast("string"))).join(of, doc, "left").drop(doc)
    stay = F.filter(F.split(F.col(text_col).cast("string"), "\n", -1), lambda x, i: F.get(F.col(flags)["keep"], i))
    n_lines = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(flags)).cast("long")
    n_stay = F.size(F.filter(flags, lambda f: f["keep"]))
    return out.select(
        *[F.when(F.col(text_col).isNotNull(), F.array_join(stay, "\n")).alias(c) if c == text_col else F.col(c) for c in docs.columns],
        n_lines.alias("n_lines"),
        F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(flags) - n_stay).cast("long").alias("n_removed"),
    )
