"""Merging findings, scoring them, and classifying a document's risk; all inside the row, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Tiers with the score of each, and what belongs to them.
SCORE = {"critical": 10, "direct": 5, "contextual": 2, "container": 0}
MEMBERS = {
    "critical": ["credit_card", "jwt", "api_key", "id_label"],
    "direct": ["email", "ph_mobile", "phone_intl", "ph_address"],
    "contextual": [
        "ipv4", "ipv6", "mac_address", "personal_label", "trigger_person_name", "trigger_age", "trigger_dob", "trigger_employer", "trigger_location", "trigger_health",
        "trigger_financial", "gazetteer_medical", "gazetteer_financial",
    ],
    "container": ["source_code"],
}
SENSITIVE = ["gazetteer_medical", "gazetteer_financial", "trigger_health", "trigger_financial"]
LEVELS = ["none", "low", "moderate", "high"]
#: Least score of a level, and the factor for so many distinct types (the last for more too).
LEAST = {"high": 10, "moderate": 5, "low": 2}
FACTORS = [1.0, 1.2, 1.4, 1.7, 2.0]


def rank(level: Column) -> Column:
    return sum((F.when(level == name, k).otherwise(0) for k, name in enumerate(LEVELS) if k), F.lit(0))


def level(number: Column) -> Column:
    return F.get(F.array(*map(F.lit, LEVELS)), number)


def key(raw: Column) -> Column:
    return F.lower(F.trim(raw))


def merge(findings: Column, by=key) -> Column:
    """One finding a key: the riskiest, of equals the first; it stands where the key first stood.

    Findings sorted by key, risk and place have each key's best one first; places sorted by key have each key's first one first.
    """
    bind = lambda value, use: F.get(F.transform(F.array(value), use), 0)  # noqa: E731  so that a sorted array is sorted once
    heads = lambda a: F.filter(a, lambda x, j: (j == 0) | (F.get(a, j - 1)["k"] != x["k"]))
    ranked = F.array_sort(F.transform(findings, lambda f, i: F.struct(by(f["raw_match"]).alias("k"), (-rank(f["risk"])).alias("r"), i.alias("i"), f.alias("f"))))
    places = F.array_sort(F.transform(findings, lambda f, i: F.struct(by(f["raw_match"]).alias("k"), i.alias("i"))))
    merged = F.zip_with(bind(ranked, heads), bind(places, heads), lambda b, p: F.struct(p["i"].alias("i"), b["f"].alias("f")))
    keys = F.transform(findings, lambda f: by(f["raw_match"]))
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), findings).otherwise(F.transform(F.array_sort(merged), lambda x: x["f"]))


def base_score(pattern_id: Column) -> Column:
    out = F.lit(0)
    for tier, ids in MEMBERS.items():
        out = F.when(pattern_id.isin(ids), SCORE[tier]).otherwise(out)
    return out


def base_total(ids: Column) -> Column:
    """ids: distinct pattern ids."""
    return F.aggregate(ids, F.lit(0), lambda a, x: a + base_score(x))


def multiplier(types: Column) -> Column:
    return F.get(F.array(*map(F.lit, FACTORS)), F.least(types, F.lit(len(FACTORS))) - 1)


def preliminary(score: Column) -> Column:
    return F.when(score >= LEAST["high"], "high").when(score >= LEAST["moderate"], "moderate").when(score >= LEAST["low"], "low").otherwise("none")


def governance(findings: Column) -> Column:
    """The rule that governs the class of a scored document."""
    of = lambda *tiers: sum((MEMBERS[t] for t in tiers), [])
    has = lambda ids, more=lambda f: F.lit(True): F.exists(findings, lambda f: f["pattern_id"].isin(ids) & more(f))
    return (
        F.when(has(of("critical"), lambda f: F.coalesce(f["validated"], F.lit(False))), "critical_entity")
        .when(has(of("critical", "direct")) & has(SENSITIVE), "sensitive_context")
        .when(F.forall(findings, lambda f: f["pattern_id"].isin(of("contextual", "container"))) & has(of("contextual")), "contextual_ceiling")
        .otherwise("none")
    )


def final_level(first: Column, rule: Column) -> Column:
    r = rank(first)
    return level(F.when(rule == "critical_entity", 3).when(rule == "sensitive_context", F.least(r + 1, F.lit(3))).when(rule == "contextual_ceiling", F.least(r, F.lit(2))).otherwise(r))


def scored(df: DataFrame, findings_col: str = "findings") -> DataFrame:
    """Add pattern_ids, base_total, multiplier, score, preliminary, governance and risk_level."""
    f = F.col(findings_col)
    d = df.withColumn("pattern_ids", F.array_distinct(F.transform(f, lambda x: x["pattern_id"])))
    d = d.withColumn("types__", F.size(F.filter("pattern_ids", lambda x: base_score(x) > 0))).withColumn("base_total", base_total(F.col("pattern_ids")))
    d = d.withColumn("multiplier", F.when(F.col("types__") > 0, multiplier(F.col("types__"))).otherwise(F.lit(1.0)))
    d = d.withColumn("raw__", F.col("base_total") * F.col("multiplier"))
    d = d.withColumn("score", F.round("raw__", 2)).withColumn("preliminary", preliminary(F.col("raw__")))
    d = d.withColumn("governance", F.when(F.col("types__") > 0, governance(f)).otherwise("none"))
    return d.withColumn("risk_level", final_level(F.col("preliminary"), F.col("governance"))).drop("types__", "raw__")


def highest_risk(findings: Column) -> Column:
    """The riskiest finding's level, "none" without findings."""
    return level(F.coalesce(F.array_max(F.transform(findings, lambda f: rank(f["risk"]))), F.lit(0)))
