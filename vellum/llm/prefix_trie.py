"""Conversation prefix trie: the tree of all beginnings of conversations, with what sharing them saves.

Conversations are sorted by the digests of their turns, so those that begin alike stand side by side, and the longest common
prefix (LCP) of neighbours is an edge between them. A union-find takes a partition's edges in descending depth: components that an edge
merges become children of a branching node at the edge's depth, and all nodes between a component's own depth and that of the edge
that ends it have the same members. A component at a partition's border may go on beyond it; such components are contracted
into one atom for each depth, and atoms of ``GROUP`` neighbouring partitions are merged by the same union-find, round after round.

What travels: 32 characters a turn, never texts. Between partitions go the border's atoms alone, one for each depth at which
the conversation there branches, each with the lengths of a conversation of its own.

Defined results: rows without a conversation id are left out; null roles and texts count as empty; a null turn comes first; turns
of one number stand by role, then by digest, repeated rows each; equal conversations are members of the same nodes; a conversation without
turns is a member of the root; without conversations there are no nodes; other columns are not read. A conversation's digests
are held in one row, so a conversation may have some ten million turns.
"""

from __future__ import annotations

import functools
import hashlib
from itertools import accumulate
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vellum.llm.common import cut, small_batches

GROUP, MARK, CHUNK = 64, 32, 10_000
WORD = r"[^\x20\x09-\x0D]+"
_SCHEMA = (
    "kind string, part long, seq long, ref long, up long, conv_id long, depth long, low long, n long, leaves long, shared long, children long, prior array<long>, "
    "parent_conv long, parent_ref long, before long, first string, last string, ends string"
)
_TYPES = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "array<long>": pa.list_(pa.int64())}[t]) for n, t in (c.split(" ") for c in _SCHEMA.split(", "))])


def turns_of(conversations: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turns array<struct<mark string, words long>>: every conversation's turns in order, as digests of role and text."""
    who, what = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"),
        F.struct(
            F.col(turn).isNotNull().alias("numbered"),
            F.col(turn).alias("turn"),
            who.alias("role"),
            F.md5(F.concat(F.length(who).cast("string"), F.lit(":"), who, what).cast("binary")).alias("mark"),
            F.regexp_count(what, F.lit(WORD)).cast("long").alias("words"),
        ).alias("t"),
    )
    ordered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return ordered.select("conv_id", F.transform("t", lambda t: F.struct(t["mark"].alias("mark"), t["words"].alias("words"))).alias("turns"))


def rebuilt(sequences: DataFrame, every: int, head: Column) -> DataFrame:
    """Every conversation with its first ``head`` turns in place of its own first ones taken from the conversation that begins its run of ``every`` ids.

    ``head``: an int column over conv_id. Where that conversation has fewer turns or is absent, as many turns as it has come first.
    """
    first = F.col("conv_id") - F.pmod("conv_id", F.lit(every))
    heads = sequences.where(F.col("conv_id") == first).select(F.col("conv_id").alias("base"), F.col("turns").alias("lead"))
    d = sequences.withColumn("base", first).withColumn("h", head).join(heads, "base", "left")
    lead = F.slice(F.coalesce("lead", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    return d.select("conv_id", F.concat(lead, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


class Component:
    """Neighbouring conversations that share ``depth`` turns or are one: members, leaves below, words saved, least id, children at that depth.

    words[k] is the number of words in the first k turns. kids are closed nodes whose parent it will be; refs the atoms of the
    round before that it is made of; ends the conversations that end at its depth. An open one may go on beyond the border.
    """

    __slots__ = ("depth", "words", "n", "leaves", "shared", "conv_id", "children", "kids", "refs", "ends", "open")

    def __init__(self, depth, words, n, leaves, shared, conv_id, children, kids, refs, ends):
        self.depth, self.words, self.n, self.leaves, self.shared = depth, words, n, leaves, shared
        self.conv_id, self.children, self.kids, self.refs, self.ends, self.open = conv_id, children, kids, refs, ends, False

    def join(self, other: Component) -> None:
        """Take in a neighbour of the same depth."""
        self.shared += other.shared + self.words[self.depth]
        self.n, self.leaves, self.children, self.conv_id = self.n + other.n, self.leaves + other.leaves, self.children + other.children, min(self.conv_id, other.conv_id)
        for mine, more in ((self.kids, other.kids), (self.refs, other.refs), (self.ends, other.ends)):
            mine += more
        self.open |= other.open


class Forest:
    """The union-find over one run of components and the edges between neighbours."""

    def __init__(self, atoms: list[Component], edges: list[int], whole: bool):
        self.nodes: list[dict] = []
        self.refs: list[tuple] = []  # ref, conv_id, depth
        if not whole:
            atoms[0].open = atoms[-1].open = True
        self.up, self.comp, self.kept = list(range(len(atoms))), atoms, []
        for i in sorted(range(len(edges)), key=lambda i: -edges[i]):
            self._edge(i, edges[i])
        self.rest = []
        if whole:
            self._close(self.comp[self._find(0)], -1)
        else:
            bounds = sorted(self.kept)
            self.rest = [(self.comp[self._find(i)], e) for i, e in zip([0, *(b + 1 for b in bounds)], [None, *(edges[b] for b in bounds)], strict=True)]

    def _find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def _edge(self, i: int, depth: int) -> None:
        left, right = self._find(i), self._find(i + 1)
        a, b = self._raised(left, depth), self._raised(right, depth)
        if a and b:
            if a.n < b.n:  # the larger one's lists stay
                a, b, left, right = b, a, right, left
            a.join(b)
            self.up[right] = left
        else:
            self.kept.append(i)
            if a or b:
                (a or b).open = True  # it hangs on one that is open

    def _raised(self, at: int, depth: int) -> Component | None:
        """The component as part of a node at this depth; None if it cannot be closed here."""
        c = self.comp[at]
        if c.depth > depth:
            if c.open:
                return None
            kid, leaves = self._close(c, depth)
            c = self.comp[at] = Component(depth, c.words, c.n, leaves, c.shared, c.conv_id, 1, [kid], [], [])
        return c

    def _close(self, c: Component, low: int) -> tuple[int, int]:
        leaves = c.leaves if c.children else 1
        prior = [0] * (low < 0) + c.words[max(low, 0) : c.depth]
        ends = None if c.refs else hashlib.sha256(",".join(map(str, sorted(c.ends))).encode()).hexdigest()
        self.nodes.append({"conv_id": c.conv_id, "depth": c.depth, "low": low, "n": c.n, "leaves": leaves, "shared": c.shared, "children": c.children, "prior": prior, "ends": ends})
        for kid in c.kids:
            self.nodes[kid]["parent_conv"] = c.conv_id
        self.refs += [(r, c.conv_id, c.depth) for r in c.refs]
        return len(self.nodes) - 1, leaves

    def rows(self, level: int, part: int, first: str, last: str) -> list[dict]:
        """Closed nodes, what became of the refs, and the border's atoms with the conversations that end there."""
        out = [{"kind": "node", **n} for n in self.nodes]
        out += [{"kind": "ref", "ref": r, "conv_id": c, "depth": d} for r, c, d in self.refs]
        edges = [e for _, e in self.rest][1:]
        for seq, (c, before) in enumerate(self.rest):
            ref = (level << 56) | (part << 24) | seq
            out.append({
                "kind": "atom", "part": part, "seq": seq, "ref": ref, "conv_id": c.conv_id, "depth": c.depth, "n": c.n, "leaves": c.leaves, "shared": c.shared, "children": c.children,
                "prior": c.words[: c.depth + 1], "before": before, "first": first if seq == 0 else None, "last": last if seq == len(edges) else None,
            })
            for kid in c.kids:
                out[kid]["parent_ref"] = ref
            out += [{"kind": "ref", "ref": r, "up": ref} for r in c.refs]
            ids = sorted(c.ends)
            out += [{"kind": "ends", "ref": ref, "part": part, "seq": k, "ends": ",".join(map(str, ids[k : k + CHUNK]))} for k in range(0, len(ids), CHUNK)]
        return out


def shared_turns(a: str, b: str) -> int:
    return len(commonprefix((a, b))) // MARK


def _table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pydict({n: [r.get(n) for r in rows] for n in _TYPES.names}, schema=_TYPES)


def _first_round(batches):
    atoms, edges, first, last = [], [], None, ""
    for batch in batches:
        for conv_id, key, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if first is None:
                first = key
            else:
                edges.append(shared_turns(last, key))
            last = key
            atoms.append(Component(len(words), list(accumulate(words, initial=0)), 1, 0, 0, conv_id, 0, [], [], [conv_id]))
    if atoms:
        yield from _table(Forest(atoms, edges, False).rows(0, TaskContext.get().partitionId(), first, last)).to_batches(max_chunksize=10_000)


def _later_round(level: int, whole: bool):
    def run(key, table):
        atoms, edges, first, last = [], [], None, ""
        for r in sorted(table.to_pylist(), key=lambda r: (r["part"], r["seq"])):
            if atoms:
                edges.append(r["before"] if r["seq"] else shared_turns(last, r["first"]))
            first = r["first"] if first is None else first
            last = last if r["last"] is None else r["last"]
            atoms.append(Component(r["depth"], r["prior"], r["n"], r["leaves"], r["shared"], r["conv_id"], r["children"], [], [r["ref"]], []))
        return _table(Forest(atoms, edges, whole).rows(level, key[0].as_py(), first, last))

    return run


def _digests(batches):
    """Of rows by node in order of place: one SHA-256 a node, over its texts joined by commas."""
    node, digest = None, None
    for batch in batches:
        done = []
        for conv_id, depth, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if node != (conv_id, depth):
                if node:
                    done.append((*node, digest.hexdigest()))
                node, digest = (conv_id, depth), hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(("conv_id", "depth", "sha"), zip(*done, strict=True), strict=True)))
    if node:
        yield pa.RecordBatch.from_pydict({"conv_id": [node[0]], "depth": [node[1]], "sha": [digest.hexdigest()]})


def trie(sequences: DataFrame, *, group: int = GROUP, partitions: int | None = None) -> DataFrame:
    """A row for each node from sequences of turns (see ``turns_of``): conv_id (least member), depth, parent_conv_id, n_convs, n_children,
    n_leaves (childless nodes below, or itself), saved_tokens (words that members beyond the first need not repeat, summed over the nodes below and
    its own), ends_sha256 (of the ids, joined by commas, of members with exactly these turns)."""
    spark = sequences.sparkSession
    small_batches(spark)
    spread = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = cut(sequences.select("conv_id", F.array_join("turns.mark", "").alias("key"), F.col("turns.words").alias("words")))
    # the id is part of the order, so copies of one conversation lie in many partitions
    line = keyed.repartitionByRange(spread, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    rounds, level = [cut(line.mapInArrow(_first_round, _SCHEMA))], 0
    parts = rounds[0].rdd.getNumPartitions()
    while level == 0 or parts > 1:
        level, parts = level + 1, -(-parts // group)
        atoms = rounds[-1].where("kind = 'atom'").withColumn("g", F.floor(F.col("part") / group).cast("long"))
        rounds.append(cut(atoms.groupBy("g").applyInArrow(_later_round(level, parts <= 1), _SCHEMA)))
    rows = functools.reduce(DataFrame.unionByName, rounds)

    refs = rows.where("kind = 'ref'").select("ref", "up", "conv_id", "depth")
    closed = refs.where("up is null").drop("up")
    known, moved = closed, refs.where("up is not null").select(F.col("ref").alias("from"), F.col("up").alias("ref"))
    for _ in range(level - 1):
        known = closed.unionByName(moved.join(known, "ref").select(F.col("from").alias("ref"), "conv_id", "depth"))
    known = cut(known)

    ends = rows.where("kind = 'ends'").select("ref", "part", "seq", "ends").join(known, "ref").drop("ref")
    ends = ends.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "part", "seq").select("conv_id", "depth", "ends")
    ends = ends.mapInArrow(_digests, "conv_id long, depth long, sha string")

    columns = ["conv_id", "depth", "low", "n", "leaves", "shared", "children", "prior", "parent_conv", "ends"]
    nodes = rows.where("kind = 'node'").select(*columns, "parent_ref")
    parent = known.select(F.col("ref").alias("parent_ref"), F.col("conv_id").alias("found"))
    nodes = nodes.where("parent_ref is null").drop("parent_ref").unionByName(
        nodes.where("parent_ref is not null").join(parent, "parent_ref").withColumn("parent_conv", F.col("found")).select(*columns)
    )
    none = hashlib.sha256(b"").hexdigest()
    merged = nodes.where("ends is null").drop("ends").join(ends.withColumnRenamed("sha", "ends"), ["conv_id", "depth"], "left")
    nodes = nodes.where("ends is not null").unionByName(merged.withColumn("ends", F.coalesce("ends", F.lit(none))))

    each = nodes.select("*", F.posexplode("prior").alias("k", "before"))
    depth = F.col("low") + 1 + F.col("k")
    own = depth == F.col("depth")
    return each.select(
        "conv_id",
        depth.alias("depth"),
        F.when(F.col("k") == 0, F.col("parent_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(own, F.col("children")).otherwise(F.lit(1).cast("long")).alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("shared") - (F.col("n") - 1) * F.col("before")).alias("saved_tokens"),
        F.when(own, F.col("ends")).otherwise(none).alias("ends_sha256"),
    )


def with_turns(nodes: DataFrame, conversations: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Nodes of a trie of the conversations as they stand, with role and text of their last turns (null at the root)."""
    who, what = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    mark = F.md5(F.concat(F.length(who).cast("string"), F.lit(":"), who, what).cast("binary"))
    line = F.row_number().over(W.partitionBy(conv).orderBy(F.asc_nulls_first(turn), who, mark))
    last = conversations.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), line.cast("long").alias("depth"), who.alias("role"), what.alias("text"))
    return nodes.join(last, ["conv_id", "depth"], "left")

