"""What near-dedup and components cost besides their data: tasks, which each leave files of shuffles; links in tiles confirmed by the texts."""

from __future__ import annotations

import random
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pytest

from vellum.llm import simhash
from vellum.llm.common import components


@contextmanager
def _tasks(spark, group):
    """Yields a list that holds the number of tasks run meanwhile, at a fixed number of partitions, once the block ends."""
    sc, held, ran = spark.sparkContext, {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false"}, []
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    sc.setJobGroup(group, group)
    try:
        yield ran
        tracker = sc.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
        ran.append(sum(s.numCompletedTasks for s in stages if s))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)


def test_settled_edges_take_no_round(spark):
    edges = spark.createDataFrame([(k, k % 5) for k in range(5, 200)], "u long, v long").repartition(8)
    with _tasks(spark, "settled") as ran:
        got = {r.node: r.root for r in components(edges).collect()}
    assert got == {k: k % 5 for k in range(200)}
    assert ran[0] <= 8 * 10


@pytest.mark.parametrize("kind", ["chain", "random", "hub", "empty"])
def test_components_of_any_shape(spark, kind):
    rnd = random.Random(7)
    pairs = {
        "chain": [(k, k + 1) for k in range(40)],
        "random": [(rnd.randrange(150), rnd.randrange(150)) for _ in range(110)],
        "hub": [(99, k) for k in range(99)] + [(k, 99) for k in range(100, 140)] * 2,
        "empty": [],
    }[kind]
    root = {x: x for p in pairs if p[0] != p[1] for x in p}
    for a, b in pairs:
        if a != b and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {k: low if r == high else r for k, r in root.items()}
    got = components(spark.createDataFrame(pairs, "u long, v long")).collect()
    assert sorted((r.node, r.root) for r in got) == sorted(root.items())


def test_near_dedup_leaves_few_tasks(spark):
    """A family of texts at similarities around the bound, so that tiles and both rounds of components are at work."""
    rnd = random.Random(8)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
    texts = []
    for _ in range(60):
        words = list(base)
        for _ in range(rnd.randrange(14)):
            words[rnd.randrange(200)] = f"x{rnd.randrange(10**6)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    with _tasks(spark, "near") as ran:
        got = {r.doc_id: r.component for r in simhash.verified_classes(docs).collect()}
    sets = [simhash._shingle_set(t, 5) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert got == dict(enumerate(root))
    assert ran[0] <= 8 * 115


def test_tile_confirms_links_by_the_texts(monkeypatch):
    """Texts whose hashes are the same by chance are not linked, and do not stand for those that are."""
    hashes = {"a b": [1, 2], "c d": [1, 2], "a b ": [1, 2]}
    monkeypatch.setattr(simhash, "shingles", lambda text, shingle: np.array(hashes[text], np.uint64))
    rows = [(10, 10, "a b", True), (20, 20, "c d", False), (30, 20, "a b ", False), (40, 40, "c d", False)]
    part = pd.DataFrame(rows, columns=["key", "root", "text", "left"])
    assert simhash._tile_links(part, 5, 0.8).values.tolist() == [[10, 20]]
    assert simhash._tile_links(part[part["key"] != 30], 5, 0.8).empty
