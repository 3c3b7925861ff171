"""A training-data pipeline over ``documents``: quality, line dedup, near-dedup, decontamination, encoding.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns
of ``documents``. The driver of the stages stores each result as Parquet and rereads it for the next.

Defined results: a null text counts as empty in every stage; repeated rows (same id, same text) stay or go together, but near-dedup
keeps rows of the class's smallest id, so repeats of that id stay; rows without an id stay in near-dedup; empty tables give no
rows; other columns are carried along, whatever they are called.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from vellum.llm import bpe, decontaminate, line_dedup, quality, simhash
from vellum.llm.common import delete, new_path, table, unused
from vellum.llm.queries import RANKS

THRESHOLD = 0.3
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labels outside the held-out fifth."""
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    voter = quality.fit(docs, table(spark, sf_dir, "labels").where(learn))
    return docs.where(quality.scorer(spark, voter)(F.col("text")) >= THRESHOLD)


def aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the columns of these names, which an operator adds itself, renamed; and the columns' names before by those now, in order."""
    now = {c: unused(docs, f"{c}_of_table") if c.lower() in names else c for c in docs.columns}
    return docs.withColumnsRenamed({c: n for c, n in now.items() if c != n}), {n: c for c, n in now.items()}


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that stand, equal or nearly so, earlier in the corpus; all documents stay."""
    moved, names = aside(docs, "n_lines", "n_removed")
    kept = line_dedup.dedup(moved).select(*[F.col(n).alias(c) for n, c in names.items()])
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near-duplicates; documents without an id stay.

    Near-duplicates share four fifths or more of their five-word shingles.
    """
    first = simhash.verified_classes(docs).where(F.col("component") == F.col("doc_id")).select("doc_id").distinct()
    return docs.join(first, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth lies in benchmark windows."""
    moved, names = aside(docs, "n_words", "n_hit", "n_items", "items", "spans")
    found = decontaminate.contained(moved, table(spark, sf_dir, "benchmark"))
    return found.where(~decontaminate.contaminated()).select(*[F.col(n).alias(c) for n, c in names.items()])


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian uint32), round_trip: whether the ids decode to the text."""
    return bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, round_trip=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_near),
    ("benchmark decontamination", decontaminated),
    ("byte-level BPE", encoded),
]

#: SQL expresses neither the classifier nor the fingerprints; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after another; a stage's stored result is deleted once its successor's is stored."""
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = new_path(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            delete(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
