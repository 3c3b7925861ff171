"""The scan: normalise, detect by both paths, merge, score, classify, redact. One narrow stage; nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vellum.functions.normalize import legacy, normalize
from vellum.operators import lexicon, redact, rules, score
from vellum.plans import policy


def findings(df: DataFrame, text_col: str = "text", *, profile: str = "documented", mode: str = "strict", rule_list=rules.RULES) -> DataFrame:
    """Normalised texts and the merged findings of both paths."""
    d = normalize(df, text_col, profile)
    d = lexicon.with_trigger_findings(d)
    d = d.withColumn("all__", F.concat(rules.pattern_findings(F.col("text_regex"), mode, rule_list), lexicon.term_findings(F.col("text_nlp")), F.col("triggers")))
    return d.withColumn("findings", score.merge(F.col("all__"))).drop("all__", "triggers")


def scan(df: DataFrame, text_col: str = "text", *, profile: str = "documented", mode: str = "strict", rule_list=rules.RULES) -> DataFrame:
    """All columns of ``df`` and masked, text_regex, text_nlp, was_caps_converted, findings, the score's parts, risk_level, safe_text, submit_allowed.

    Null and blank texts have no findings, score 0, level "none".
    """
    d = score.scored(findings(df, text_col, profile=profile, mode=mode, rule_list=rule_list))
    return redact.with_safe_text(d, text_col).withColumn("submit_allowed", policy.submit_allowed(F.col("risk_level")))


def explode_findings(scanned: DataFrame, *keys: str) -> DataFrame:
    """A row for each finding."""
    return each(scanned, F.col("findings"), *keys)


def each(df: DataFrame, found: Column, *keys: str) -> DataFrame:
    """A row for each finding of an array.

    The outer explode keeps Spark from testing the array's size in a filter of its own, which would work the array out twice.
    """
    return df.select(*keys, F.explode_outer(found).alias("f")).where("f.pattern_id is not null").select(*keys, "f.*")


def legacy_scan(df: DataFrame, text_col: str = "text", mode: str = "strict") -> DataFrame:
    """The older pipeline: pattern rules only, merged by the match as it stands, classed by the riskiest."""
    d = df.withColumn("normalised", legacy(F.col(text_col)))
    d = d.withColumn("findings", score.merge(rules.pattern_findings(F.col("normalised"), mode), by=lambda raw: raw))
    return d.withColumn("risk_level", score.highest_risk(F.col("findings")))
