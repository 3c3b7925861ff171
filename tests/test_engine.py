"""The engine's golden prompts, rule cases and quirks, null and empty texts, and event state."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vellum.functions import normalize as norm, validators
from vellum.operators import rules, score
from vellum.plans import policy, scan as plans
from vellum.sources import tables
from vellum.streaming import events as ev

# text, score, level, governance, pattern ids
GOLDEN = [
    ("my name is Juan Dela Cruz and i live in Manila, i am 25 years old, i have diabetes", 20.0, "moderate", "contextual_ceiling", "gazetteer_medical trigger_person_name trigger_age trigger_location trigger_health"),
    ("my card is 4111 1111 1111 1111 please help", 10.0, "high", "critical_entity", "credit_card"),
    ("TIN: 123-456-789", 10.0, "high", "critical_entity", "id_label"),
    ("i was arrested and my salary is 50000, i work at Acme, i live in cebu, my birthday is 1990, i have asthma", 24.0, "high", "none", "gazetteer_medical gazetteer_legal trigger_dob trigger_location trigger_health trigger_employer trigger_financial"),
    ("my salary is 50000, i work at Acme, i live in cebu, my birthday is 1990, i have asthma", 24.0, "moderate", "contextual_ceiling", "gazetteer_medical trigger_dob trigger_location trigger_health trigger_employer trigger_financial"),
    ("email me at a@b.co about my mortgage", 8.4, "high", "sensitive_context", "email gazetteer_financial"),
    ("I learn 3 languages daily", 2.0, "low", "contextual_ceiling", "trigger_financial"),
    ("I work as a nurse and I work at Acme", 0.0, "none", "none", ""),
    ("i was diagnosed with diabetes", 2.0, "low", "contextual_ceiling", "gazetteer_medical"),
    ("i was born on May 5 1990", 0.0, "none", "none", ""),
    ("Brgy. Poblacion, Makati City", 0.0, "none", "none", ""),
    ("visit Street and increase now", 5.0, "moderate", "none", "ph_address"),
    ("i am a muslim", 0.0, "none", "none", "gazetteer_nationality_religion trigger_religion"),
    ("call me at +1 (555) 867-5309", 5.0, "moderate", "none", "phone_intl"),
    ("I suffer from asthma. My email is jo@x.com", 12.6, "high", "sensitive_context", "email gazetteer_medical trigger_health"),
    ("contact 09271234567 now", 12.0, "high", "none", "ph_mobile phone_intl"),
    ("see ```a\n\n\n\nb``` ok", 0.0, "none", "none", "source_code"),
    (None, 0.0, "none", "none", ""),
    ("   ", 0.0, "none", "none", ""),
]


def test_golden_prompts(spark):
    d = spark.createDataFrame([(k, g[0]) for k, g in enumerate(GOLDEN)], "id int, text string")
    got = {r.id: r for r in plans.scan(d).collect()}
    for k, (text, points, level, governance, ids) in enumerate(GOLDEN):
        r = got[k]
        assert (r.score, r.risk_level, r.governance, " ".join(r.pattern_ids)) == (points, level, governance, ids), text
    assert [f.raw_match for f in got[0].findings if f.pattern_id == "trigger_person_name"] == ["My name is. Juan Dela"]
    assert [f.raw_match for f in got[15].findings] == ["09271234567", " 0927123456"]
    assert got[16].findings[0].raw_match == "```a\n\nb```"
    assert got[17].safe_text == ""


def test_fast_mode_leaves_cards_unvalidated(spark):
    d = spark.createDataFrame([("card 1234 5678 1234 5678",)], "text string")
    assert plans.scan(d).first().score == 0
    r = plans.scan(d, mode="fast").first()
    assert (r.score, r.governance, r.findings[0].validated) == (10.0, "none", False)


CASES = [
    ("credit_card", "4111111111111111", ["4111111111111111"], ["************1111"]),
    ("credit_card", "4111 1111 1111 1111 x", ["4111 1111 1111 1111 "], ["4111 1111 1111 1111 "]),
    ("credit_card", "4111111111111112", [], []),
    ("phone_intl", "card 4111111111111111", [" 4111111111", ][:1], [" 411111xxxx"]),
    ("ipv6", "2001:db8::1", ["2001:db8::"], ["[REDACTED-IPv6]"]),
    ("ipv4", "10.1.2.3 and 300.1.1.1", ["10.1.2.3"], ["10.1.xxx.xxx"]),
    ("mac_address", "00-1A-2b-3c-4d-5e", ["00-1A-2b-3c-4d-5e"], ["00-1A-xx-xx-xx-xx"]),
    ("ph_address", "Brgy. Bagong Lipunan", [], []),
    ("ph_address", "increase on Main Street and increase", ["Street and increase"], ["[PHILIPPINE ADDRESS REMOVED]"]),
    ("id_label", "TIN: 1\nx", ["TIN: 1"], ["TIN: [REDACTED]"]),
    ("personal_label", "éage: 4", ["age: 4"], ["age: [REDACTED]"]),
    ("email", "x@y", [], []),
    ("jwt", "eyJa.eyJb.c", ["eyJa.eyJb.c"], ["[REDACTED-JWT]"]),
    ("api_key", "token = abcdefghijklmnopqrst", ["token = abcdefghijklmnopqrst"], ["token = [REDACTED-KEY]"]),
    ("ph_mobile", "+63 917 123 4567", ["+63 917 123 4567"], ["+63 917 12xxxxxx"]),
]


def test_rule_cases(spark):
    for rule, text, raw, safe in CASES:
        d = spark.createDataFrame([(text,)], "text string")
        f = d.select(rules.rule_findings(F.col("text"), rules.BY_ID[rule]).alias("f")).first().f
        assert ([x.raw_match for x in f], [x.safe_version for x in f]) == (raw, safe), (rule, text)


def test_merge_keeps_first_place_and_highest_risk(spark):
    rows = [("A", "low"), ("b", "low"), (" a ", "high"), ("a", "high")]
    f = "array(" + ",".join(f"named_struct('pattern_id','p{k}','label','l','risk','{r}','raw_match','{m}','safe_version','s','validated',true,'source','x','ord',{k})" for k, (m, r) in enumerate(rows)) + ")"
    got = spark.range(1).select(score.merge(F.expr(f)).alias("f")).first().f
    assert [(x.pattern_id, x.risk) for x in got] == [("p2", "high"), ("p1", "low")]


@pytest.mark.parametrize("profile,text,want", [
    ("documented", "use `const x = 12345` here", "use `const x = 12345` here"),
    ("as_written", "use `const x = 12345` here", "use\n`const x = 12345`\nhere"),
    ("documented", "MY NAME IS JUAN DELA CRUZ", "My name is juan dela cruz"),
    ("as_written", "MY NAME IS JUAN DELA CRUZ", "MY NAME IS JUAN DELA CRUZ"),
    ("documented", "a ```js\n  x\n``` b", "a\n```js\n  x\n```\nb"),
    ("documented", "ﬁne １２​ ­z\r\nnext", "fine 12 z next"),
    ("documented", "TIN: 123", "TIN: 123"),
])
def test_regex_layer(spark, profile, text, want):
    assert norm.normalize(spark.createDataFrame([(text,)], "text string"), profile=profile).first().text_regex == want


def test_places_come_longest_first_and_in_the_lists_order(spark):
    d = spark.createDataFrame([("Cebu City in Region VII, Central Visayas; then Calabarzon, Region XII and Region IV-A, MIMAROPA, Region V",), ("nowhere",)], "text string")
    got = [r.p for r in d.select(validators.places(F.col("text")).alias("p")).collect()]
    at = {p: k for k, p in enumerate(got[0])}
    assert at["calabarzon"] < at["region vii"] < at["region xii"] and at["mimaropa"] < at["region v"] < at["region x"]
    assert got[1] == []


def test_long_texts(spark):
    """A million characters through every rule, the whole scan and the merge."""
    n = 1_000_000
    texts = ["```" + "ab\n" * (n // 3) + "```", "`" * n, "a" * n, "1 " * (n // 2), "a." * (n // 2) + "@b.co", "x@" + "b." * (n // 2) + "co", "a:" * (n // 2), "eyJ" + "a" * n, "name: " + "y" * n, "street " * (n // 7), "token=" + "k" * n]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(len(texts))
    for rule in rules.RULES:
        d.select(F.size(rules.rule_findings(F.col("text"), rule)).alias("n")).collect()
    found = d.where("id = 0").select(rules.rule_findings(F.col("text"), rules.BY_ID["source_code"]).alias("f")).first().f
    assert [len(x.raw_match) for x in found] == [len(texts[0])]
    r = plans.scan(d.where("id = 0")).first()
    assert [f.pattern_id for f in r.findings] == ["source_code"] and r.safe_text.strip() == "[CODE BLOCK REMOVED]"
    many = spark.createDataFrame([(" ".join(f"a{k % 20_000}@b.co" for k in range(40_000)),)], "text string")
    merged = many.select(score.merge(rules.rule_findings(F.col("text"), rules.BY_ID["email"])).alias("f")).first().f
    assert [f.raw_match for f in merged] == [f"a{k}@b.co" for k in range(20_000)]


def test_unknown_predicates_keep_matches_and_values_are_cleaned(spark):
    d = spark.createDataFrame([("'jo@x.com'",), ("`10.0.0.1` ",), ("a" * 65 + "@x.com",)], "m string")
    assert [r.v for r in d.select(validators.passes("no such", F.col("m")).alias("v")).collect()] == [True] * 3
    assert [(r.e, r.i) for r in d.select(validators.is_email(F.col("m")).alias("e"), validators.is_ipv4(F.col("m")).alias("i")).collect()] == [(True, False), (False, True), (False, False)]


def test_policy_tables(spark):
    d = spark.createDataFrame([("high",), ("moderate",), ("medium",), ("active",), (None,)], "s string")
    got = d.select(policy.badge(F.col("s")).alias("b"), policy.panel(F.col("s")).alias("p"), policy.theme(F.col("s")).alias("t")).collect()
    assert [tuple(r.b) for r in got] == [("!", "#D32F2F"), ("", "#388E3C"), ("!", "#F57C00"), ("ON", "#9E9E9E"), ("", "#388E3C")]
    assert [tuple(r.p) for r in got][::3] == [("high", "High risk detected", "High", True), ("idle", "Waiting for activity…", "Idle", False)]
    assert got[1].t.dot == "#f97316" and got[4].t.dot == "#22c55e"
    why = spark.createDataFrame([("ipv4",), ("trigger_religion",)], "i string").select(policy.reason(F.col("i")).alias("r"), policy.explanation(F.col("i")).alias("k")).collect()
    assert why[0].r == "Matched pattern: IPv4 address.\nRule: RA 10173, SPI.\nCategory: Network Identifier." and why[0].k == "Network Identifier"
    assert why[1].r == "Matched a known sensitive data pattern."


def test_digits_are_left_alone(spark):
    """Normalising changes no digit group, so numbers are matched as they were written."""
    d = spark.createDataFrame([("call 0917 123 4567, card 4111-1111-1111-1111 or 1,234.50",)], "text string")
    assert norm.normalize(d).first().text_regex == "call 0917 123 4567, card 4111-1111-1111-1111 or 1,234.50"


def test_safe_text_replaces_longest_first(spark):
    r = plans.scan(spark.createDataFrame([("mail jo@x.com and bo.jo@x.com, card 4111111111111111, call 09271234567",)], "text string")).first()
    assert r.safe_text == "mail j***@x.com and b***@x.com, card ************1111, call 09271xxxxxx"


def test_rules_table(spark):
    stored = tables.bundled_rules(spark).where("id in ('email', 'jwt')").withColumn("risk", F.lit("high"))
    found = tables.rules_from(stored)
    assert [(r.id, r.risk) for r in found] == [("jwt", "high"), ("email", "high")]
    assert tables.rules_from(None) is rules.RULES


EVENTS = [  # tab, milliseconds, event, type, level, text
    (1, 0, 1, "input", "high", "a"), (1, 100, 2, "input", "high", "a"), (1, 700, 3, "input", "high", "b"), (1, 1500, 4, "input", "none", ""),
    (1, 2500, 5, "input", "high", "c"), (1, 3000, 6, "navigate", None, None), (1, 4000, 7, "input", "high", "c"), (2, 0, 8, "input", "low", "z"),
]


def _events(spark):
    d = spark.createDataFrame(EVENTS, "tab_id long, ms long, event_id long, type string, risk_level string, text string")
    return d.select("tab_id", F.timestamp_millis("ms").alias("ts"), "event_id", "type", "risk_level", "text")


def test_batch_events(spark):
    e = _events(spark)
    ids = lambda d: sorted(r.event_id for r in d.collect())
    assert ids(ev.debounced(e)) == [2, 3, 4, 5, 6, 7, 8]
    assert ids(ev.changed(e)) == [1, 3, 4, 5, 6, 7, 8]
    assert ids(ev.auto_open(e)) == [1, 5, 7]
    assert {r.tab_id: r.badge for r in ev.badges(e).collect()} == {1: "high", 2: "low"}


def test_gate_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    _events(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = ev.gate_stream(tables.event_stream(spark, str(tmp_path / "in")))
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.event_id for r in rows if r.opens) == [1, 5, 7]
    assert sorted(r.event_id for r in rows if r.unchanged) == [2]


ACTS = [  # tab, milliseconds, event, type, level, text
    (1, 0, 1, "input", None, "a"), (1, 100, 2, "input", None, "ab"), (1, 200, 3, "submit", None, "ab"), (1, 900, 4, "result", "high", None), (1, 1000, 5, "submit", None, "ab"),
    (1, 2000, 6, "input", None, "ab"), (1, 2500, 7, "submit", None, "ab"), (1, 3000, 8, "input", None, " "), (1, 3500, 9, "submit", None, " "), (1, 4000, 10, "input", None, "ab"),
    (1, 5000, 11, "result", "none", None), (1, 5100, 12, "submit", None, "ab"), (1, 5200, 13, "send_anyway", None, None), (1, 6000, 14, "input", None, "ab"), (2, 0, 15, "submit", None, "x"),
]


def _acts(spark):
    d = spark.createDataFrame(ACTS, "tab_id long, ms long, event_id long, type string, risk_level string, text string")
    return d.select("tab_id", F.timestamp_millis("ms").alias("ts"), "event_id", "type", "risk_level", "text")


def test_scan_states(spark):
    got = ev.scan_states(_acts(spark)).where("tab_id = 1").collect()
    steps = sorted((int(r.ts.timestamp() * 1000), r.event_id, r.state) for r in got)
    assert steps == [
        (0, 1, "PENDING"), (100, 2, "PENDING"), (500, 2, "SCANNING"), (900, 4, "DONE"), (2000, 6, "PENDING"), (2400, 6, "DONE"), (3000, 8, "PENDING"), (3400, 8, "IDLE"),
        (4000, 10, "PENDING"), (4400, 10, "SCANNING"), (5000, 11, "DONE"), (6000, 14, "PENDING"), (6400, 14, "SCANNING"),
    ]


SUBMITS = {3: ("high", False, True), 5: ("high", False, False), 7: (None, False, True), 9: ("none", True, False), 12: ("none", True, False), 15: (None, False, True)}


def test_submit_gate(spark, tmp_path):
    assert {r.event_id: (r.level, r.allowed, r.waited) for r in ev.submit_gate(_acts(spark)).collect()} == SUBMITS
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    _acts(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = ev.submit_stream(tables.event_stream(spark, str(tmp_path / "in")))
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.event_id: (r.level, r.allowed, r.waited) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {k: v for k, v in SUBMITS.items() if k != 15}  # that one still waits


def test_correlated(spark):
    at = lambda ms: F.timestamp_millis(F.lit(ms))
    requests = spark.range(3).select(F.col("id").alias("scan_id"), at(0).alias("ts"), F.lit(1500).alias("budget_ms"))
    rows = [(0, 900, "high"), (0, 1000, "none"), (1, 1600, "high"), (9, 10, "low")]
    results = spark.createDataFrame(rows, "scan_id long, ms long, risk_level string").select("scan_id", F.timestamp_millis("ms").alias("ts"), "risk_level")
    assert sorted((r.scan_id, r.risk_level, r.timed_out) for r in ev.correlated(requests, results).collect()) == [(0, "high", False), (1, "none", True), (2, "none", True)]


def test_rule_cache_and_scan_stream(spark, tmp_path):
    path, now = str(tmp_path / "rules"), [0.0]
    cache = tables.RuleCache(spark, path, ttl=10, clock=lambda: now[0])
    assert cache.get() is rules.RULES  # nothing to read yet
    tables.bundled_rules(spark).where("id = 'email'").write.parquet(path)
    assert [r.id for r in cache.get()] == ["email"]
    tables.bundled_rules(spark).where("id in ('email', 'ipv4')").write.mode("overwrite").parquet(path)
    assert len(cache.get()) == 1
    now[0] = 11.0
    assert len(cache.get()) == 2
    tables.bundled_rules(spark).write.mode("overwrite").parquet(path)
    cache.refresh()
    assert len(cache.get()) == len(rules.RULES)
    events = [(1, 0, 1, "input", None, "mail jo@x.com"), (2, 0, 2, "input", None, "fine")]
    d = spark.createDataFrame(events, "tab_id long, ms long, event_id long, type string, risk_level string, text string")
    d.select("tab_id", F.timestamp_millis("ms").alias("ts"), "event_id", "type", "risk_level", "text").write.parquet(str(tmp_path / "in"))
    q = tables.scan_stream(tables.event_stream(spark, str(tmp_path / "in")), cache, str(tmp_path / "results"), str(tmp_path / "relay"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert q.exception() is None
    assert sorted((r.tab_id, r.risk_level, r.n_findings) for r in spark.read.parquet(str(tmp_path / "relay")).collect()) == [(1, "moderate", 1), (2, "none", 0)]
    assert spark.read.parquet(str(tmp_path / "results")).where("risk_level = 'moderate'").first().safe_text == "mail j***@x.com"
