"""Timed streams over several micro-batches, with rows late and out of order, against their batch forms; upserts; stored rules."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from vellum.operators import rules
from vellum.plans import scan as plans
from vellum.sources import tables
from vellum.streaming import events as ev, timed

COLUMNS = "tab_id long, ms long, event_id long, type string, risk_level string, text string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _frame(spark, rows):
    d = spark.createDataFrame(rows, COLUMNS)
    return d.select("tab_id", F.timestamp_millis("ms").alias("ts"), "event_id", "type", "risk_level", "text")


def _rows(seed, n=160, tabs=4):
    """Events of some tabs over two minutes, about a second apart, many less than the debounce gap; times repeat."""
    rnd, out = random.Random(seed), []
    for k in range(n):
        kind = rnd.choice(["input", "input", "input", "result", "submit", "submit", "send_anyway", "navigate"])
        out.append((rnd.randrange(tabs), rnd.randrange(0, 120_000, 100), k, kind, rnd.choice(["none", "low", "high"]), rnd.choice(["a", "b", " ", None, "a b"])))
    return sorted(out, key=lambda r: (r[1], r[2]))


def _batches(rows, size, seed, reach=8):
    """Micro-batches of the rows, moved by a few places so that rows come after later ones."""
    rnd = random.Random(seed)
    moved = [r for _, r in sorted(enumerate(rows), key=lambda x: x[0] + rnd.uniform(0, reach))]
    return [moved[k : k + size] for k in range(0, len(moved), size)]


def _played(spark, tmp_path, make, batches, end=10_000_000):
    """What a stream gives for the batches in turn, and the last progress; a last batch of a tab of its own moves the watermark on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    for k, rows in enumerate([*batches, [(99, end, 99_999, "tick", None, None)], [(99, end + 1, 99_998, "tick", None, None)]]):
        _frame(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{k:03d}"))
    source = spark.readStream.schema(tables.EVENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(str(tmp_path / "in"))
    q = make(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return spark.read.parquet(str(tmp_path / "out")), q


def test_scan_states_stream_equals_batch(spark, tmp_path, seed=1):
    rows = _rows(seed)
    got, q = _played(spark, tmp_path, lambda s: timed.scan_state_stream(s, late="30 seconds"), _batches(rows, 30, seed))
    want = ev.scan_states(_frame(spark, rows))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert len(q.recentProgress) > 4


def test_timed_gate_stream_equals_batch_and_forgets(spark, tmp_path):
    rows = _rows(3)
    got, q = _played(spark, tmp_path, lambda s: timed.timed_gate_stream(s, late="30 seconds", ttl=600_000), _batches(rows, 40, 3), end=3_600_000)
    key = lambda d: sorted((tuple("" if v is None else v for v in r) for r in d.collect()), key=str)
    want = timed.timed_gate(_frame(spark, rows))
    assert key(got) == key(want.select(*got.columns))
    kinds = {(r.timed_out, r.allowed, r.level is None) for r in got.collect()}
    assert {(True, False, True), (False, False, True), (False, True, False), (False, False, False)} <= kinds
    left = [s["numRowsTotal"] for s in q.lastProgress["stateOperators"]]
    assert left[0] <= 6  # of all tabs but the last batch's own nothing is left


def test_timed_gate_cases(spark):
    rows = [
        (1, 0, 1, "input", None, "x"), (1, 100, 2, "submit", None, "x"), (1, 1600, 3, "result", "none", None),  # in time to the millisecond
        (2, 0, 1, "input", None, "x"), (2, 100, 2, "submit", None, "x"), (2, 1601, 3, "result", "none", None),  # a millisecond late
        (3, 0, 1, "input", None, "x"), (3, 100, 2, "submit", None, "x"), (3, 900, 3, "input", None, "y"), (3, 950, 4, "result", "none", None),  # void
        (4, 0, 1, "submit", None, " "), (5, 0, 1, "submit", None, "mail jo@x.com"),
    ]
    gate = timed.timed_gate(_frame(spark, rows))
    got = {r.tab_id: (r.level, r.allowed, r.waited, r.timed_out, r.text) for r in gate.collect()}
    assert got == {1: ("none", True, True, False, None), 2: (None, False, True, True, "x"), 3: (None, False, True, False, None), 4: ("none", True, False, False, None), 5: (None, False, True, True, "mail jo@x.com")}
    after = {r.tab_id: (r.level, r.allowed) for r in timed.with_fallback(gate).collect()}
    assert after == {1: ("none", True), 2: ("none", True), 3: (None, False), 4: ("none", True), 5: ("moderate", False)}


def test_panel_stream_equals_batch(spark, tmp_path):
    rows = _rows(4)
    got, _ = _played(spark, tmp_path, lambda s: timed.panel_stream(s, late="30 seconds"), _batches(rows, 35, 4))
    d = _frame(spark, rows)
    rows_of = [r for r in got.collect() if r.tab_id != 99]
    assert sorted(r.event_id for r in rows_of if r.opens) == sorted(r.event_id for r in ev.auto_open(d).collect())
    assert sorted(r.event_id for r in rows_of if not r.unchanged) == sorted(r.event_id for r in ev.changed(d, kind="type").collect())


def test_late_rows_are_left_out(spark, tmp_path):
    batches = [[(1, 1_000, 1, "input", None, "a")], [(1, 60_000, 2, "input", None, "b")], [(1, 90_000, 3, "input", None, "c")], [(1, 5_000, 4, "input", None, "late")]]
    got, _ = _played(spark, tmp_path, lambda s: timed.scan_state_stream(s, late="1 second"), batches)
    assert sorted({r.event_id for r in got.collect()}) == [1, 2, 3]


def test_debounced_stream_equals_batch(spark, tmp_path):
    rows = [r for r in _rows(5) if r[3] == "input"]
    got, _ = _played(spark, tmp_path, lambda s: ev.debounced_stream(s, late="30 seconds"), _batches(rows, 20, 5))
    want = ev.debounced(_frame(spark, rows)).select("tab_id", "ts", "text", "n_events", "burst_start")
    assert sorted(map(str, got.where("tab_id <> 99").collect())) == sorted(map(str, want.collect()))


def test_correlated_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rnd = random.Random(6)
    requests = [(k, 5000 + k * 1000, rnd.choice([1500, 1700, 2500])) for k in range(40)]
    results = [(k, at + rnd.choice([100, 1500, 1501, 1700, 2500, 4000]), rnd.choice(["none", "high"])) for k, at, _ in requests for _ in range(rnd.randint(0, 3))] + [(777, 5050, "high")]
    end = 1_000_000
    for k in range(0, 60, 10):
        q = [r for r in requests if k * 1000 <= r[1] - 5000 < (k + 10) * 1000] + [(1000 + k, end + k, 1500)] * (k == 50)
        r = [x for x in results if k * 1000 <= x[1] - 5000 < (k + 10) * 1000] + [(5000, end + 10_000, "none")] * (k == 50)
        spark.createDataFrame(q or [(None, None, None)], "scan_id long, ms long, budget_ms long").where("ms is not null").select("scan_id", F.timestamp_millis("ms").alias("ts"), "budget_ms").coalesce(1).write.parquet(str(tmp_path / "q" / f"{k:03d}"))
        spark.createDataFrame(r or [(None, None, None)], "scan_id long, ms long, risk_level string").where("ms is not null").select("scan_id", F.timestamp_millis("ms").alias("ts"), "risk_level").coalesce(1).write.parquet(str(tmp_path / "r" / f"{k:03d}"))
    stream = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / name))
    out = timed.correlated_stream(stream("q", "scan_id long, ts timestamp, budget_ms long"), stream("r", "scan_id long, ts timestamp, risk_level string"), most_ms=3000, late="5 seconds")
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    got = sorted((r.scan_id, r.risk_level, r.timed_out) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.scan_id < 1000)
    d = spark.createDataFrame(requests, "scan_id long, ms long, budget_ms long").select("scan_id", F.timestamp_millis("ms").alias("ts"), "budget_ms")
    e = spark.createDataFrame(results, "scan_id long, ms long, risk_level string").select("scan_id", F.timestamp_millis("ms").alias("ts"), "risk_level")
    assert got == sorted((r.scan_id, r.risk_level, r.timed_out) for r in ev.correlated(d, e).collect())


def test_badge_stream_and_a_batch_done_again(spark, tmp_path):
    rows = _rows(7)
    for k, part in enumerate(_batches(rows, 30, 7)):
        _frame(spark, part).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k:03d}"))
    source = spark.readStream.schema(tables.EVENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    into = tables.LatestTable(spark, str(tmp_path / "badges"), "tab_id", ["ts", "event_id"], buckets=3)
    assert into.read() is None
    q = tables.badge_stream(source, into, str(tmp_path / "ck"))
    q.awaitTermination(300)
    assert q.exception() is None
    known = lambda: sorted((r.tab_id, r.badge, r.ts) for r in into.read().collect())
    want = sorted((r.tab_id, r.badge, r.ts) for r in ev.badges(_frame(spark, rows)).collect())
    assert known() == want
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "badges").glob("batch=*"))
    again = _frame(spark, _batches(rows, 30, 7)[-1]).select("tab_id", ev.badge_state(F.col("risk_level"), F.col("type")).alias("badge"), "ts", "event_id")
    newest = again.groupBy("tab_id").agg(F.max_by(F.struct("badge", "ts", "event_id"), F.struct("ts", "event_id")).alias("r")).select("tab_id", "r.*")
    for _ in range(2):
        into.upsert(newest, last)
    assert known() == want


def test_result_stream(spark, tmp_path):
    _frame(spark, [(1, 0, 1, "input", None, "mail jo@x.com"), (2, 0, 2, "input", None, None)]).write.parquet(str(tmp_path / "in"))
    scanned = plans.scan(tables.event_stream(spark, str(tmp_path / "in")).drop("risk_level")).select("tab_id", "risk_level", "safe_text")
    q = tables.result_stream(scanned, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(300)
    assert q.exception() is None
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [(1, "moderate", "mail j***@x.com"), (2, "none", "")]


def test_stored_rules_of_unknown_ids(spark):
    part = lambda *xs: [tuple(x) for x in xs]
    stored = spark.createDataFrame(
        [
            ("badge_no", "Badge", "high", r"\bB-\d{6}\b", None, part(("first", "2"), ("text", "****"), ("last", "2")), 1),
            ("plate", "Plate", "low", r"\b[A-Z]{3} \d{4}\b", None, part(("before", " "), ("text", " "), ("mask", "#")), 2),
            ("email", "Mail", "high", r"[a-z]+@[a-z.]+", "email", part(("text", "<"), ("after", "@"), ("text", ">")), 3),
            ("broken", "x", "low", r"(unclosed", None, None, 4), ("empty", "x", "low", r"z*", None, None, 5), ("odd", "x", "dire", "q+", None, None, 6),
            ("bad_part", "x", "low", "q+", None, part(("third", "1")), 7), (None, "x", "low", "q+", None, None, 8), ("plain", "Plain", "low", "qq+", None, None, 9), ("plain", "later", "low", "vv+", None, None, 10),
        ],
        tables.RULE,
    )
    found = tables.rules_from(stored)
    assert [(r.id, r.label) for r in found] == [("badge_no", "Badge"), ("plate", "Plate"), ("email", "Mail"), ("plain", "Plain")]
    d = spark.createDataFrame([("my B-123456 and ABC 1234, jo@x.com qqq",)], "text string")
    r = plans.scan(d, rule_list=found).first()
    assert r.safe_text == "my B-****56 and ABC ### ####, <x.com> [REDACTED]"
    assert [f.pattern_id for f in r.findings] == ["badge_no", "plate", "email", "plain"]
    assert r.risk_level == "moderate"  # ids without a tier do not score


def test_rule_cache_survives_unreadable_files(spark, tmp_path):
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules" / "part-0.parquet").write_bytes(b"not a table")
    cache = tables.RuleCache(spark, str(tmp_path / "rules"))
    assert cache.get() is rules.RULES


def test_bundled_lexicon(spark):
    got = tables.bundled_lexicon(spark)
    assert {k: v.count() for k, v in got.items()} == {"terms": 62, "triggers": 38, "places": 206}
    assert got["triggers"].orderBy("ord").first().phrase == "my name is"
