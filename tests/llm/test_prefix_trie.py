"""The prefix trie against a dictionary of prefixes, over few and many partitions and rounds of merging."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from vellum.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, depth int, key string, words string, n long"


def _sequences(rows):
    convs = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs[c].append((t is not None, t or 0, role, mark, text))
    return {c: [(r, x) for _, _, r, _, x in sorted(ts)] for c, ts in convs.items()}


def _rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + turns[h:]
    return out


def _brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) if children[p] else 1
        own = len(re.findall(prefix_trie.WORD, p[-1][1])) if p else 0
        saved[p] = (len(members[p]) - 1) * own + sum(saved[k] for k in children[p])
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        (min(cs), len(p), min(members[p[:-1]]) if p else -1, len(cs), len(children[p]), leaves[p], saved[p], sha(c for c in cs if len(convs[c]) == len(p)))
        for p, cs in members.items()
    )


def _rows(nodes):
    return sorted(tuple(-1 if v is None else v for v in r) for r in nodes.collect())


def _conversations(seed, n):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        if rnd.random() < 0.1:
            continue
        turns = [rnd.choice("ab") + " w" * rnd.randint(0, 1) for _ in range(rnd.choice([0, 1, 2, 3, 5, 9]))]
        if c % 3 == 0:
            turns = ["hot", "second turn", "x"][: rnd.randint(1, 3)] + turns  # a third of all begin alike
        if c % 7 == 0:
            turns = ["copy of many words"] * 2
        rows += [(c, k, rnd.choice(["user", "user", None]), t) for k, t in enumerate(turns)]
    deep = 10_000
    rows += [(deep, k, "user", "hot" if k == 0 else f"t{k}") for k in range(120)] + [(deep + 1, k, "user", "hot" if k == 0 else f"t{k}") for k in range(90)]
    rows += [(50_001, None, None, None), (50_001, 2, "b", ""), (50_001, 2, "a", ""), (50_001, 2, "a", ""), (None, 0, "user", "lost"), (60_003, 0, "user", "alone")]
    return rows


@pytest.mark.parametrize("seed,n,partitions,group", [(1, 150, 4, 64), (2, 200, 23, 2), (3, 120, 9, 3), (4, 60, 1, 64)])
def test_trie_equals_brute_force(spark, seed, n, partitions, group):
    rows = _conversations(seed, n)
    d = spark.createDataFrame([(*r, 1, "k", "w", 2) for r in rows], SCHEMA)
    convs = _sequences(rows)
    plain = prefix_trie.trie(prefix_trie.turns_of(d), partitions=partitions, group=group)
    assert _rows(plain) == _brute(convs)
    if partitions < 9:
        again = prefix_trie.rebuilt(prefix_trie.turns_of(d), 20, (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int"))
        assert _rows(prefix_trie.trie(again, partitions=partitions, group=group)) == _brute(_rebuilt(convs))


def test_forest_of_one_run_equals_rounds():
    """The union-find alone, over every way of cutting a sorted run of conversations in parts."""
    rnd = random.Random(5)
    for _ in range(300):
        keys = sorted("".join(rnd.choice("AB") * prefix_trie.MARK for _ in range(rnd.randint(0, 5))) for _ in range(rnd.randint(1, 12)))
        convs = {c: [("", k[i : i + 1]) for i in range(0, len(k), prefix_trie.MARK)] for c, k in enumerate(keys)}
        want = sorted((c, d, n) for c, d, _, n, *_ in _brute(convs))
        size = rnd.randint(1, 5)
        level, tables = 0, []
        for part, at in enumerate(range(0, len(keys), size)):
            own = keys[at : at + size]
            atoms = [prefix_trie.Component(len(k) // prefix_trie.MARK, [0] * (len(k) // prefix_trie.MARK + 1), 1, 0, 0, at + i, 0, [], [], [at + i]) for i, k in enumerate(own)]
            edges = [prefix_trie.shared_turns(a, b) for a, b in zip(own, own[1:], strict=False)]
            tables += prefix_trie.Forest(atoms, edges, False).rows(0, part, own[0], own[-1])
        nodes = [r for r in tables if r["kind"] == "node"]
        atoms, parts = [r for r in tables if r["kind"] == "atom"], -(-len(keys) // size)
        while level == 0 or parts > 1:
            level, parts, following = level + 1, -(-parts // 2), []
            for g in range(parts):
                mine = [r for r in atoms if r["part"] // 2 == g]
                following += prefix_trie._later_round(level, parts <= 1)((_Scalar(g),), prefix_trie._table(mine)).to_pylist()
            nodes += [r for r in following if r["kind"] == "node"]
            atoms = [r for r in following if r["kind"] == "atom"]
        got = sorted((r["conv_id"], d, r["n"]) for r in nodes for d in range(r["low"] + 1, r["depth"] + 1))
        assert got == want, (keys, size)


class _Scalar(int):
    def as_py(self):
        return int(self)


def test_query_has_turnless_members(spark, tmp_path):
    """Conversation 60003 keeps no turn of its own where its id asks for more than it has, and its run has no first one."""
    rows = [(c, 0, "user", "x") for c in range(40_001, 40_012)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert _rows(queries.op12_prefix_trie(spark, str(tmp_path))) == _brute(_rebuilt(_sequences(rows)))


def test_query_equals_sql(spark, tmp_path):
    import compare
    from conftest import SF

    assert not compare.differences(queries.op12_prefix_trie(spark, SF), compare.duck(SF), queries.ORACLES["op12_prefix_trie"])


def test_sql_equals_brute_force():
    import duckdb
    import pandas as pd

    rows = _conversations(6, 150)
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.register("conversations", conversations)
    got = con.execute(queries.ORACLES["op12_prefix_trie"]).fetchall()
    assert sorted(tuple(-1 if v is None else v for v in r) for r in got) == _brute(_rebuilt(_sequences(rows)))


def test_empty_table_and_turns(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie(prefix_trie.turns_of(none)).collect() == []
    d = spark.createDataFrame([(1, 0, "u", "a b"), (1, 1, "v", "c"), (2, 0, "u", "a b")], "conv_id long, turn long, role string, text string")
    shown = prefix_trie.with_turns(prefix_trie.trie(prefix_trie.turns_of(d)), d)
    assert sorted((r.depth, r.conv_id, r.text or "", r.saved_tokens) for r in shown.collect()) == [(0, 1, "", 2), (1, 1, "a b", 2), (2, 1, "c", 0)]
