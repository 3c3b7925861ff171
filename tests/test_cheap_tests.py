"""Cheap tests and searches that stand before costly ones change no result."""

from __future__ import annotations

import random

import compare
from conftest import SF
from pyspark.sql import functions as F

from vellum import queries
from vellum.functions import normalize as norm
from vellum.functions.dialect import SPACES, java
from vellum.operators import lexicon, lexicon_data, rules


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_candidates_are_the_windows_near_a_phrase():
    """Phrases with edits of any kind, of spaces too, against all windows."""
    rnd = random.Random(6)
    phrases, found = [p for p, *_ in lexicon_data.TRIGGERS], 0
    for _ in range(800):
        parts = []
        for _ in range(rnd.randint(0, 4)):
            p = list(rnd.choice(phrases))
            for _ in range(rnd.randint(0, 6)):
                at, c = rnd.randrange(len(p) + 1), rnd.choice("abismyné  x" + "".join(p))
                p[at : at + rnd.randint(0, 1)] = [c] if rnd.random() < 0.7 else []
            parts += ["".join(p), *rnd.choice([[], ["is"], [""], ["my x"]])]
        text = " ".join(parts)
        words = text.split(" ")
        windows = {n: [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] for n in lexicon.SIZES}
        want = [[i for i, w in enumerate(ws) if any(p.count(" ") + 1 == n and 1 - _edits(w, p) / max(len(w), len(p)) >= 0.8 for p in phrases)] for n, ws in windows.items()]
        assert (lexicon.candidates(text) or [[] for _ in lexicon.SIZES]) == want, text
        found += sum(map(len, want))
    assert found > 500


def test_windows_of_all_words_are_not_put_together(spark):
    d = lexicon.with_trigger_findings(spark.createDataFrame([("nothing to see here",), ("my naem is Jo",), (None,), ("",)], "text_nlp string"))
    assert "sequence(" not in d._jdf.queryExecution().optimizedPlan().toString()
    assert {r.text_nlp: [f.pattern_id for f in r.triggers] for r in d.collect()} == {"nothing to see here": [], "my naem is Jo": ["trigger_person_name"], None: [], "": []}


def test_normaliser_equals_its_plain_forms(spark):
    rnd = random.Random(7)
    some = ["a", "B", "b", " ", "  ", "Ab", "Abc", " Abc", " Bcd", "c.", ". ", "? b", "\n", "\t", "\xa0", " ", "　", "é", "É", "﻿", "​", "\xad", "İ", "-", "x Abc Def Ghi"]
    texts = ["".join(rnd.choice(some) for _ in range(rnd.randint(0, 14))) for _ in range(8000)]
    c = F.col("t")
    share = F.length(F.regexp_replace(c, "[^A-Z]", "")) / F.length(F.regexp_replace(c, "[^a-zA-Z]", ""))
    pairs = {
        "bounds": (norm.sentence_bounds(c), F.regexp_replace(c, "([a-z])( )([A-Z][a-z]{2,})", "$1.$2$3")),
        "collapse": (norm.collapse(c), F.trim(F.regexp_replace(c, f"[{SPACES}]+", " "))),
        "invisible": (norm.strip_invisible(c), F.regexp_replace(c, norm.INVISIBLE, "")),
        "ratio": (norm.caps_ratio(c) > norm.CAPS_SHARE, F.coalesce(share > norm.CAPS_SHARE, F.lit(False))),
        "starts": (F.lower(norm.raise_starts(c)), F.lower(c)),
        "raised": (norm.raise_starts(F.concat(c, F.lit(". b"))).endswith(". B"), F.lit(True)),
    }
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *[(~a.eqNullSafe(b)).alias(k) for k, (a, b) in pairs.items()])
        assert d.where(" or ".join(pairs)).take(3) == []
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_rules_with_first_characters_and_digits_equal_plain_patterns(spark):
    rnd = random.Random(8)
    some = ["4111 1111 1111 1111", "0917 123 4567", "0917", "+63", " ", "-", "10.0.0.1", "00:1a:2b:3c:4d:5e", "Street", "ST. ", "brgy", "xst", "token=", "Access Key: ", "abcdefghijklmnopqrstu", "123", "é", "_", "(555) 867-5309", "aa-", "B"]
    texts = ["".join(rnd.choice(some) for _ in range(rnd.randint(0, 8))) for _ in range(4000)]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    for rule in rules.RULES:
        if rule.pattern in rules.FIRST or rule.pattern in rules.DIGITS:
            plain = F.regexp_extract_all("t", F.lit(java(rule.pattern)), F.lit(0))
            got = d.select("t", rules.matches(F.col("t"), rule, F.col("t").rlike("[0-9]")).alias("new"), plain.alias("plain")).collect()
            assert [r.t for r in got if r.new != r.plain] == [] and sum(bool(r.new) for r in got) > 5, rule.id


def test_terms_at_the_edges_of_a_text(spark):
    some = ["loan", "xloan", "loan_", "éloanç", "a Loan", "(TB)", "sex offender", "tbİ", "", None]
    d = spark.createDataFrame([(t,) for t in some], "t string").select("t", F.transform(lexicon.term_findings(F.col("t")), lambda f: f["raw_match"]).alias("f"))
    assert [r.f for r in d.collect()] == [["loan"], [], [], ["loan"], ["Loan"], ["TB"], ["sex offender"], ["tb"], [], None]


def test_corpus_by_rule(spark):
    """The report equals its SQL, and its scan puts no windows of all words together."""
    d = queries.QUERIES["corpus_by_rule"](spark, SF)
    assert "sequence(" not in d._jdf.queryExecution().optimizedPlan().toString()
    assert not compare.differences(d, compare.duck(SF), queries.ORACLES["corpus_by_rule"])
