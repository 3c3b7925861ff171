"""Long texts take time in proportion to their length, and what makes it so changes no result."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from vellum.functions import normalize as norm
from vellum.functions.dialect import SPACE_CHARACTERS, java
from vellum.operators import lexicon_data, redact, rules
from vellum.plans import scan as plans

N = 1_000_000


def test_trimming(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(SPACE_CHARACTERS + "ab​\u0085\x1c") for _ in range(rnd.randint(0, 12))) for _ in range(2000)]
    d = spark.createDataFrame([(t,) for t in texts], "text string").select("text", norm.trim_space(F.col("text")).alias("t"))
    assert all(r.t == r.text.strip(SPACE_CHARACTERS) for r in d.collect())


@pytest.mark.parametrize("rule,alphabet", [("email", "ab.@_-c o"), ("jwt", ["eyJ", "eyJ", "eyJ", ".", ".", "a", "-", " ", "=", "e", "yJ"])])
def test_runs_are_tried_once_with_equal_matches(spark, rule, alphabet):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(4000)] + ["a@b.co_x@y.com.z@q.org", "eyJa.eyJb.eyJc.eyJd.e", "xeyJeyJ.eyJa.b eyJ.eyJa.b"]
    pattern = rules.BY_ID[rule].pattern
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    got = d.select("text", F.regexp_extract_all("text", *map(F.lit, rules.search(pattern))).alias("new"), F.regexp_extract_all("text", F.lit(java(pattern)), F.lit(0)).alias("plain")).collect()
    assert [r.text for r in got if r.new != r.plain] == [] and sum(bool(r.new) for r in got) > 50


LONG = {
    "white space": "a" + " " * N + "b", "line ends": "a" + "\r\n" * (N // 2) + "b", "before an address": "a" * N + "@b.co", "dots before an address": "a." * (N // 2) + "@b.co", "signs": "a@" * (N // 2), "domain": "x@" + "b." * (N // 2),
    "eyJ": "eyJ" * (N // 3), "eyJ segments": "eyJa." * (N // 5), "backticks": "`" * N, "fences": "``` " * (N // 4), "keywords": "secret " * (N // 7), "prose": "the quick brown fox is here and i am " * (N // 37), "digits": "12 34" * (N // 5),
}


def test_whole_scan(spark):
    """A row of each kind; one plan for all, since planning takes longer than most of the texts."""
    d = spark.createDataFrame(list(LONG.items()), "kind string, text string").repartition(4)
    began = time.time()
    got = {r.kind: r for r in plans.scan(d).select("kind", "risk_level", F.size("findings").alias("n"), F.length("safe_text").alias("size")).collect()}
    assert time.time() - began < 200 and set(got) == set(LONG)
    assert got["white space"].n == 0 and got["white space"].size == N + 2
    assert got["fences"].n == 1 and got["backticks"].n == 1  # equal blocks are one finding


def _fold(text, swaps):
    for a, b in swaps:
        text = text.replace(a, b) if a else text
    return text


def test_replay_equals_fold():
    rnd = random.Random(3)
    for k in range(20_000):
        letters = "ab" if k % 2 else "abc"
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 14)))
        swaps = [("".join(rnd.choice(letters) for _ in range(rnd.randint(0, 4))), "".join(rnd.choice(letters + "X") for _ in range(rnd.randint(0, 4)))) for _ in range(rnd.randint(0, 6))]
        assert redact.Replay(text, swaps).run() == _fold(text, swaps), (text, swaps)


def test_many_addresses_are_redacted(spark):
    n = 32_000
    text = " ".join(f"user{k}@host{k % 97}.example.com" for k in range(n))
    began = time.time()
    r = plans.scan(spark.createDataFrame([(text,)], "text string")).select("safe_text", F.size("findings").alias("n")).first()
    assert time.time() - began < 60 and r.n == n
    assert r.safe_text == " ".join(f"u***@host{k % 97}.example.com" for k in range(n))


def test_fold_and_replay_in_spark(spark):
    rnd = random.Random(4)
    rows = []
    for k in range(60):
        words = ["loan", "my loan is", "a@b.co", "10.0.0.1", "loan loan", "x"]
        text = " ".join(rnd.choice(words) for _ in range(30))
        found = [(w + rnd.choice(["", " x", " loan"]), rnd.choice(["[TERM: loan]", "a***@b.co", "", "x x"]), i) for i in range(rnd.choice([3, 90])) for w in [rnd.choice(words)]]
        rows.append((k, text, found))
    d = spark.createDataFrame(rows, "id int, text string, f array<struct<raw_match: string, safe_version: string, ord: bigint>>")
    got = {r.id: (r.s, r.t) for r in redact.with_safe_text(d, "text", "f", "s").withColumn("t", redact.safe_text(F.col("text"), F.col("f"))).collect()}
    for k, text, found in rows:
        want = _fold(text, [(a, b) for a, b, _ in sorted(found, key=lambda f: (-len(f[0]), f[2]))])
        assert got[k] == (want, want)
    none = d.withColumn("text", F.lit(None).cast("string"))
    assert {r.s for r in redact.with_safe_text(none, "text", "f", "s").collect()} == {""}


def test_trigger_places_equal_windows(spark):
    """The first window similar to a phrase, against a loop over all windows."""
    rnd = random.Random(5)
    words = sorted({w for p, *_ in lexicon_data.TRIGGERS for w in p.split()}) + ["naem", "liev", "the", "x", ""]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 25))) for _ in range(300)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    from vellum.operators import lexicon

    phrases = [p for p, *_ in lexicon_data.TRIGGERS]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string").withColumn("w", F.split(F.lower("text"), " "))
    sizes = sorted({p.count(" ") + 1 for p in phrases})
    d = d.withColumns({f"at{n}": F.expr(lexicon.near_places("w", n)) for n in sizes})
    d = d.select("id", *[F.expr(lexicon.first_place(f"at{p.count(' ') + 1}", "w", p)).alias(f"p{k}") for k, p in enumerate(phrases)])
    for r in d.collect():
        ws = texts[r.id].lower().split(" ")
        for k, p in enumerate(phrases):
            n = p.count(" ") + 1
            want = next((i for i in range(len(ws) - n + 1) if (w := " ".join(ws[i : i + n])) is not None and 1 - distance(w, p) / max(len(w), len(p)) >= 0.8), None)
            assert r[f"p{k}"] == want, (texts[r.id], p)
