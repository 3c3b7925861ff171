"""Tables, event streams and rule tables in; results out."""

from __future__ import annotations

import time
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from vellum.operators import lexicon_data, rules, score
from vellum.plans.scan import scan
from vellum.streaming.events import badge_state

EVENT = T.StructType().add("tab_id", "long").add("ts", "timestamp").add("event_id", "long").add("type", "string").add("risk_level", "string").add("text", "string")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table in too few pieces to keep the cluster busy, dealt out evenly; one in enough pieces as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 2 * cores else df.repartition(cores)


def pages_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Visible text of pages: scripts, styles and tags out. A plain stand-in for an element's text."""
    text = F.regexp_replace(F.coalesce(html_col, F.lit("")), r"(?is)<(script|style)\b.*?</\1>|<[^>]*>", " ")
    return pages.withColumn("text", F.trim(F.regexp_replace(text, r"\s+", " ")))


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """A stream of Parquet files of events."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


#: Most rules that a stored table may have; they are read by the driver, as each becomes expressions of the plan.
MOST_RULES = 1000
RULE = "id string, label string, risk string, pattern string, predicate string, safe array<struct<part: string, argument: string>>, ord int"


def bundled_rules(spark: SparkSession) -> DataFrame:
    """The rules as a table: id, label, risk, pattern, predicate, safe (null: the replacement that the id has here), ord."""
    return spark.createDataFrame([(r.id, r.label, r.risk, r.pattern, r.predicate, None, k) for k, r in enumerate(rules.RULES)], RULE)


def bundled_lexicon(spark: SparkSession) -> dict[str, DataFrame]:
    """The other bundled lists as tables: terms (category, term, risk, ord), triggers (phrase, category, risk, needs, ord), places (name, ord; longest first)."""
    terms = [(c, t, lexicon_data.TERM_RISK[c], k) for c, ts in lexicon_data.TERMS.items() for k, t in enumerate(ts)]
    triggers = [(p, c, r, need, k) for k, (p, c, r, need) in enumerate(lexicon_data.TRIGGERS)]
    return {
        "terms": spark.createDataFrame(terms, "category string, term string, risk string, ord int"),
        "triggers": spark.createDataFrame(triggers, "phrase string, category string, risk string, needs string, ord int"),
        "places": spark.createDataFrame([(p, k) for k, p in enumerate(lexicon_data.PLACES)], "name string, ord int"),
    }


def rules_from(stored: DataFrame | None) -> list[rules.Rule]:
    """The rules of a stored table in order of ord, or the bundled ones if it has none; a rule that the table lacks is off.

    Of several rows with one id the first by ord counts. A row's replacement is put together of the parts in its ``safe`` (see
    ``rules.PARTS``); without one, a known id has its own replacement, any other "[REDACTED]". Rows without an id, of an unknown risk, or whose pattern
    or replacement cannot be read are left out. A table of over ``MOST_RULES`` ids is refused.
    """
    if stored is None:
        return rules.RULES
    have = [F.col(c) if c in stored.columns else F.lit(None).cast(t).alias(c) for c, t in (("predicate", "string"), ("safe", "array<struct<part: string, argument: string>>"))]
    first = stored.where("id is not null").select("id", "ord", "label", "risk", "pattern", *have).groupBy("id").agg(F.min_by(F.struct("label", "risk", "pattern", "predicate", "safe"), F.struct("ord", "pattern")).alias("r"), F.min("ord").alias("ord"))
    rows = first.select("id", "ord", "r.*").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"a table of over {MOST_RULES} rules")
    made = [_rule(stored.sparkSession, r) for r in sorted(rows, key=lambda r: (r.ord is not None, r.ord, r.id))]
    return [r for r in made if r] or rules.RULES


def _rule(spark: SparkSession, row) -> rules.Rule | None:
    known = rules.BY_ID.get(row.id)
    try:
        pattern = spark._jvm.java.util.regex.Pattern.compile(rules.search(row.pattern or "")[0])
        safe = rules.replacement([(p.part, p.argument) for p in row.safe]) if row.safe is not None else known.safe if known else lambda m: F.lit("[REDACTED]")
    except (PySparkException, Py4JJavaError, ValueError, AttributeError):
        return None
    if row.risk not in score.LEVELS or pattern.matcher("").find():  # a pattern that finds nothing at all finds it everywhere
        return None
    needs = known.needs if known and known.pattern == row.pattern else lambda t: F.lit(True)
    return rules.Rule(row.id, row.label or row.id, row.risk, row.pattern, row.predicate or (known.predicate if known else None), safe, needs)


class RuleCache:
    """The rules of a Parquet table, read again when older than ``ttl`` seconds or refreshed; the last known, else the bundled,
    ones where it cannot be read, whatever the reason."""

    def __init__(self, spark: SparkSession, path: str, ttl: float = 3600.0, clock: Callable[[], float] = time.monotonic):
        self.spark, self.path, self.ttl, self.clock = spark, path, ttl, clock
        self.known, self.read_at = rules.RULES, None

    def refresh(self) -> None:
        self.read_at = None

    def get(self) -> list[rules.Rule]:
        if self.read_at is None or self.clock() - self.read_at >= self.ttl:
            try:
                self.known, self.read_at = rules_from(self.spark.read.parquet(self.path)), self.clock()
            except (PySparkException, Py4JJavaError, ValueError):
                self.read_at = None  # tried again at the next batch
        return self.known


class LatestTable:
    """A table of one row a key in a folder of Parquet files, brought up to date by numbered batches.

    Rows lie in buckets by key. A batch writes the buckets that it touches anew, under its number; the newest of each bucket counts. A
    batch that is done again reads only what batches before it wrote and writes over its own, so it changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, newest: list[str], buckets: int = 64):
        self.spark, self.path, self.key, self.newest, self.buckets = spark, path, key, newest, buckets

    def read(self, before: int | None = None) -> DataFrame | None:
        """The rows, of batches with a number under ``before`` if given; None if there are none."""
        try:
            rows = self.spark.read.parquet(self.path)
        except AnalysisException:
            return None
        rows = rows if before is None else rows.where(F.col("batch") < before)
        # the folders' names alone; a row for each bucket
        last = rows.groupBy("bucket").agg(F.max("batch").alias("batch"))
        return rows.join(F.broadcast(last), ["bucket", "batch"]).drop("batch")

    def upsert(self, changes: DataFrame, number: int) -> None:
        """Put the newest row of each key in its bucket; of equal ones the stored row stays."""
        changes = changes.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")).persist()
        old = self.read(number)
        rows = changes.withColumn("fresh", F.lit(0))
        if old is not None:
            touched = changes.select("bucket").distinct()
            rows = rows.unionByName(old.join(F.broadcast(touched), "bucket", "left_semi").withColumn("fresh", F.lit(1)))
        best = rows.groupBy("bucket", self.key).agg(F.max_by(F.struct(*[c for c in changes.columns if c not in ("bucket", self.key)]), F.struct(*self.newest, "fresh")).alias("r"))
        best.select(self.key, "r.*", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/batch={number}")
        changes.unpersist()


def badge_stream(events: DataFrame, into: LatestTable, checkpoint: str):
    """A started query that keeps the last state of every tab in a table until the input is used up.

    Each micro-batch is reduced to its tabs' last events, which replace older ones there; nothing is kept in the stream's own state. Late
    events count by their time, those of a batch that is done again once.
    """

    def update(batch: DataFrame, number: int) -> None:
        row = F.struct(badge_state(F.col("risk_level"), F.col("type")).alias("badge"), "ts", "event_id")
        last = batch.where("tab_id is not null").groupBy("tab_id").agg(F.max_by(row, F.struct("ts", "event_id")).alias("r")).select("tab_id", "r.*")
        into.upsert(last, number)

    return events.writeStream.outputMode("update").foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scan_stream(events: DataFrame, cache: RuleCache, results: str, relay: str, checkpoint: str):
    """A started query that scans every micro-batch of events by the rules of its time and writes two sinks until the input is used up.

    results: whole scans by risk level; relay: tab_id, ts, event_id, risk_level and the number of findings, for the panel. Both folders
    hold one part a batch, written over when a batch is done again after a failure, so no row comes twice.
    """

    def both(batch: DataFrame, number: int) -> None:
        scanned = scan(batch.drop("risk_level"), rule_list=cache.get()).persist()
        write_results(scanned, f"{results}/batch={number}", "overwrite")
        scanned.select("tab_id", "ts", "event_id", "risk_level", F.size("findings").alias("n_findings")).write.mode("overwrite").parquet(f"{relay}/batch={number}")
        scanned.unpersist()

    return events.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_results(scanned: DataFrame, path: str, mode: str = "append") -> None:
    """Scan results as Parquet, by risk level, so that a reader of one level reads no other."""
    scanned.write.mode(mode).partitionBy("risk_level").parquet(path)


def result_stream(scanned: DataFrame, path: str, checkpoint: str):
    """A started query that appends scan results as Parquet until the input is used up."""
    return scanned.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
