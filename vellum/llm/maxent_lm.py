"""LM scoring by a hashed maximum-entropy model with a class-factored softmax.

P(token | context) = P(class | context) * P(token | class). The class factor is a maximum-entropy model over 32 classes with
hashed features of the context: the word before, the two words before, and the word before that one (a skip), besides a bias.
The most frequent tokens are classes of their own, other frequent ones are classed by the company they keep: how often each of
the ``COMPANY`` most frequent tokens stands just before and just after them, grouped around ``KINDS`` centres. All the rest, and
tokens never seen, are classed by a hash of their last letters; inside a class a token has its smoothed share of the class's
training tokens.

Training: token counts of all training texts by a groupBy; one pass for the frequent tokens' company; one for observed feature
counts, from which the weights start; then full-batch gradient updates: each task sums the expected feature counts of its texts under the broadcast weights, two
shuffles add the tables up by block, and the driver applies observed - expected, preconditioned by the observed counts.
What is broadcast is of fixed size: the weights (4 MB) and at most ``HEAD`` frequent tokens' hashes and counts (4 MB).
Scoring runs in sparse numpy batches; counts of tokens outside that head are joined by a shuffle.

Tokens: words without ASCII white space, A-Z lower-cased, then one end token (the empty word) a text. Tokens are told apart by
64-bit XXH64. Defined results: null and empty texts are an end token alone; without training texts every count is 0; repeated
rows come back each, with equal values where id and text are equal.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from vellum.llm.common import cut, small_batches

OWN, KINDS, TAILS = 4, 20, 8
CLASSES = OWN + KINDS + TAILS
HEAD = 1 << 18
#: Tokens classed by company, tokens that count as company, weight of the overall company in a token's own, rounds of grouping.
SHAPED, COMPANY, SMOOTH, GROUPINGS = 1 << 13, 64, 20.0, 15
#: Buckets of the three feature templates: word before, two words before, skip.
BUCKETS = (1 << 13, 1 << 14, 1 << 13)
_OFFSETS = (0, BUCKETS[0], BUCKETS[0] + BUCKETS[1])
ROWS = sum(BUCKETS) + 1  # the last is the bias
ROUNDS, RATE, PRIOR, START = 2, 0.35, 8.0, (0.45, 0.35, 0.25)
_BLOCK, _BATCH, _STRIP = 512, 65536, 2048
#: Different words that a task counts before it hands them on, and tables of tasks that are added up at a time.
COUNTED_WORDS, LEVEL = 200_000, 16
_END = np.uint64(xxhash.xxh64_intdigest(b""))
_BEGIN = np.uint64(0x1234567890ABCDEF)
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), b""]


def tail_class(word: bytes) -> int:
    """Class of a token outside the head, from its last two letters."""
    return OWN + KINDS + xxhash.xxh32_intdigest(word.rstrip(b".,;:!?*#$%&|")[-2:]) % TAILS


class Head:
    """Frequent tokens by hash, most frequent first: an open-addressing table in numpy, with counts and classes.

    tails: the tokens' classes by their last letters, which stand until ``classed`` gives others (default: the first such class).
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, tails: np.ndarray | None = None):
        order = np.lexsort((hashes, -counts))
        self.hashes, self.counts = np.append(hashes[order], np.uint64(0)), np.append(counts[order], 0).astype(np.float64)
        n = len(order)
        tails = np.full(n, OWN + KINDS) if tails is None else tails[order]
        self.classes = np.concatenate([np.arange(min(OWN, n)), tails[OWN:], [-1]]).astype(np.int32)
        self.bits = max(4, (8 * n).bit_length())
        self.table = np.full(1 << self.bits, n, np.int32)
        left = np.arange(n)
        step = 0
        while len(left):
            slot = self._slot(self.hashes[left], step)
            free = self.table[slot] == n
            self.table[slot[free][::-1]] = left[free][::-1]  # of several the first stays
            left = left[self.table[slot] != left]
            step += 1
        self.steps = step

    def _slot(self, h: np.ndarray, step: int) -> np.ndarray:
        return ((((h * _M1) >> np.uint64(64 - self.bits)).astype(np.int64)) + step) & ((1 << self.bits) - 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash; the number of tokens where it is not in the head."""
        at = self.table[self._slot(h, 0)]
        none = len(self.hashes) - 1
        open_ = np.flatnonzero((self.hashes[at] != h) & (at != none))
        for step in range(1, self.steps):
            if not len(open_):
                break
            at[open_] = self.table[self._slot(h[open_], step)]
            open_ = open_[(self.hashes[at[open_]] != h[open_]) & (at[open_] != none)]
        at[open_] = none
        return at

    def classed(self, table: np.ndarray) -> None:
        """Class the first ``SHAPED`` tokens by their company, the rows of a table that ``company`` summed up."""
        n = min(SHAPED, len(self.hashes) - 1)
        if n > OWN:
            self.classes[OWN:n] = OWN + kinds(table[OWN:n].astype(np.float64), self.counts[OWN:n])


def kinds(table: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Group rows of counts around ``KINDS`` centres: number of the group of each row, most frequent rows first.

    Rows are compared by the roots of their smoothed shares; the first centres are frequent rows far from each other.
    """
    overall = table.sum(axis=0) / max(1.0, table.sum())
    x = np.sqrt((table + SMOOTH * overall) / (table.sum(axis=1, keepdims=True) + SMOOTH))
    some = x[: 100 * KINDS]
    centres, apart = x[:1], ((some - x[0]) ** 2).sum(axis=1)
    for _ in range(KINDS - 1):
        far = int(np.argmax(apart * np.sqrt(counts[: len(some)])))
        centres = np.vstack([centres, some[far]])
        apart = np.minimum(apart, ((some - some[far]) ** 2).sum(axis=1))
    for _ in range(GROUPINGS):
        group = np.argmin((centres * centres).sum(axis=1) - 2 * (x @ centres.T), axis=1)
        mass = np.bincount(group, counts, KINDS)
        for k in np.flatnonzero(mass):
            centres[k] = counts[group == k] @ x[group == k] / mass[k]
    return group


@dataclass
class Batch:
    """Tokens of consecutive texts: hashes, head places, classes, feature rows, and where each text starts."""

    hashes: np.ndarray
    at: np.ndarray
    classes: np.ndarray
    rows: np.ndarray
    starts: np.ndarray


def batches(texts: list[str | None], head: Head):
    """Batches of whole texts of some 60,000 tokens (or one longer text)."""
    words: list[bytes] = []
    starts: list[int] = []
    for k, text in enumerate(texts):
        starts.append(len(words))
        words += tokens(text)
        if len(words) >= _BATCH or k == len(texts) - 1:
            h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
            first = np.array(starts)
            one = np.concatenate([[_BEGIN], h[:-1]])
            one[first] = _BEGIN
            two = np.concatenate([[_BEGIN], one[:-1]])
            two[first] = _BEGIN
            with np.errstate(over="ignore"):
                keys = (one * _M1, (one * _M2) ^ (two * _M3), two * _M2)
                rows = np.stack([((k * _M1) >> np.uint64(65 - b.bit_length())).astype(np.intp) + o for k, b, o in zip(keys, BUCKETS, _OFFSETS, strict=True)])
                at = head.find(h)
            classes = head.classes[at]
            for i in np.flatnonzero(classes < 0).tolist():
                classes[i] = tail_class(words[i])
            yield Batch(h, at, classes, rows, first)
            words, starts = [], []


def company(batch: Batch, into: np.ndarray) -> None:
    """Add how often each frequent token stands just before and just after each of the first ``SHAPED`` tokens."""
    before, after = batch.at[:-1], batch.at[1:]
    inside = np.ones(len(batch.at), bool)
    inside[batch.starts] = False
    for half, (near, token) in enumerate(((before, after), (after, before))):
        some = inside[1:] & (near < COMPANY) & (token < SHAPED)
        into[half * COMPANY : (half + 1) * COMPANY] += np.bincount(near[some].astype(np.intp) * SHAPED + token[some], minlength=COMPANY * SHAPED).reshape(COMPANY, SHAPED)


def _logits(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Classes by tokens, so that sums over the classes run along memory; worked out in strips that stay in a core's cache."""
    n = rows.shape[1]
    out = np.empty((CLASSES, n), np.float32)
    for at in range(0, n, _STRIP):
        r = rows[:, at : at + _STRIP]
        z = weights.take(r[0], axis=0)
        z += weights.take(r[1], axis=0)
        z += weights.take(r[2], axis=0)
        z += weights[-1]
        strip = z.T.copy()
        strip -= strip.max(axis=0)
        out[:, at : at + _STRIP] = strip
    return out


def observed(batch: Batch, into: np.ndarray) -> None:
    """Add the class by feature counts of a batch."""
    for r, o, b in zip(batch.rows, _OFFSETS, BUCKETS, strict=True):
        into[:, o : o + b] += np.bincount(batch.classes * np.intp(b) + (r - o), minlength=b * CLASSES).reshape(CLASSES, b)
    into[:, -1] += np.bincount(batch.classes, minlength=CLASSES)


def expected(batch: Batch, weights: np.ndarray, into: np.ndarray) -> None:
    """Add the model's expected class by feature counts of a batch."""
    p = np.exp(_logits(weights, batch.rows))
    p /= p.sum(axis=0)
    places = [r - o for r, o in zip(batch.rows, _OFFSETS, strict=True)]
    for k, share in enumerate(p):
        share = share.astype(np.float64)
        for at, o, b in zip(places, _OFFSETS, BUCKETS, strict=True):
            into[k, o : o + b] += np.bincount(at, share, b)
        into[k, -1] += share.sum()


def class_logs(batch: Batch, weights: np.ndarray) -> np.ndarray:
    """Natural log of P(class | context) of every token."""
    z = _logits(weights, batch.rows)
    own = z[batch.classes, np.arange(z.shape[1])]
    return own - np.log(np.exp(z).sum(axis=0))


def initial_weights(obs: np.ndarray) -> np.ndarray:
    """Damped log ratios of a feature's class shares to the overall shares; the bias has the overall shares."""
    share = (obs[-1] + 1) / (obs[-1] + 1).sum()
    w = np.log((obs + PRIOR * share) / (obs.sum(axis=1, keepdims=True) + PRIOR)) - np.log(share)
    for o, b, s in zip(_OFFSETS, BUCKETS, START, strict=True):
        w[o : o + b] *= s
    w[-1] = np.log(share)
    return np.ascontiguousarray(w, np.float32)


def _summed(docs: DataFrame, head, add_batch, size: int = ROWS, depth: int = CLASSES) -> np.ndarray:
    """Sum of a size x depth table over all texts: one table a task, added up by block in two shuffles.

    add_batch(batch, table), whose table lies depth x size, adds one batch's part; head: the broadcast head. The first shuffle adds up ``LEVEL`` tasks' tables at a
    time, so that no task of the second reads every task's table.
    """

    def rows_of(keys, tables):
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int32()), pa.array([k for _, k in keys], pa.int32()), pa.array(tables, pa.binary())], ["block", "level", "part"])

    def per_task(arrow):
        out = None
        for b in arrow:
            for at in range(0, b.num_rows, 1000):
                for batch in batches(b.column(0).slice(at, 1000).to_pylist(), head.value):
                    out = np.zeros((depth, size)) if out is None else out
                    add_batch(batch, out)
        if out is not None:
            level = TaskContext.get().partitionId() // LEVEL
            cuts = range(0, size, _BLOCK)
            yield rows_of([(k, level) for k in range(len(cuts))], [out[:, at : at + _BLOCK].T.astype(np.float32).tobytes() for at in cuts])

    def add(arrow):
        sums: dict[tuple, np.ndarray] = {}
        for b in arrow:
            for k, level, x in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                part = np.frombuffer(x, np.float32).astype(np.float64)
                sums[k, level] = sums[k, level] + part if (k, level) in sums else part
        if sums:
            yield rows_of(sums, [x.astype(np.float32).tobytes() for x in sums.values()])

    kind = "block int, level int, part binary"
    some = docs.mapInArrow(per_task, kind).repartition("block", "level").mapInArrow(add, kind)
    rows = some.withColumn("level", F.lit(0)).repartition("block").mapInArrow(add, kind).collect()
    out = np.zeros((size, depth))
    for r in rows:
        part = np.frombuffer(bytes(r.part), np.float32).reshape(-1, depth)
        out[r.block * _BLOCK : r.block * _BLOCK + len(part)] = part
    return out


def token_counts(texts: DataFrame) -> DataFrame:
    """h, k (class outside the head), c: training tokens by hash; texts has one column."""

    def rows_of(c: Counter):
        h = np.fromiter(map(xxhash.xxh64_intdigest, c), np.uint64, len(c)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array([tail_class(w) for w in c], pa.int32()), pa.array(list(c.values()), pa.int64())], ["h", "k", "c"])

    def run(arrow):
        c: Counter = Counter()
        for b in arrow:
            for t in b.column(0):
                c.update(tokens(t.as_py()))
                if len(c) > COUNTED_WORDS:
                    yield rows_of(c)
                    c.clear()
        if c:
            yield rows_of(c)

    return texts.mapInArrow(run, "h long, k int, c long").groupBy("h", "k").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    head: Head
    weights: np.ndarray
    shares: np.ndarray  # log10 of a class's denominator
    tokens: int
    types: int


def fit(texts: DataFrame, rounds: int = ROUNDS, head_size: int = HEAD) -> tuple[Model, DataFrame]:
    """The model, and h, c of the training tokens outside its head. texts: one column, the training texts."""
    small_batches(texts.sparkSession)
    counts = cut(token_counts(texts))
    binned = counts.groupBy(F.floor(F.log2("c") * 64).alias("bin")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("bin")).collect()
    low, n = 1 << 30, 0
    for r in binned:
        if n + r.n > head_size:
            break
        low, n = r.bin, n + r.n
    is_head = F.floor(F.log2("c") * 64) >= low
    top = counts.where(is_head).select("h", "k", "c").toPandas() if n else None
    hashes = top.h.to_numpy().astype(np.int64).view(np.uint64) if n else np.zeros(0, np.uint64)
    head = Head(hashes, top.c.to_numpy() if n else np.zeros(0, np.int64), top.k.to_numpy() if n else None)
    sc = texts.sparkSession.sparkContext
    head.classed(_summed(texts, sc.broadcast(head), company, SHAPED, 2 * COMPANY))
    tails = {r.k: (r.n, r.c) for r in counts.where(~is_head).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")).collect()}
    mass = np.bincount(head.classes[:-1], weights=head.counts[:-1] + 1, minlength=CLASSES).astype(np.float64) if n else np.zeros(CLASSES)
    for k in range(OWN + KINDS, CLASSES):
        types, c = tails.get(k, (0, 0))
        mass[k] += types + c + 1  # and one unknown token
    total = int(head.counts.sum()) + sum(c for _, c in tails.values())
    types = n + sum(t for t, _ in tails.values())
    seen = sc.broadcast(head)

    obs = _summed(texts, seen, observed)
    weights = initial_weights(obs)
    for _ in range(rounds):
        now = sc.broadcast(weights)
        gradient = obs - _summed(texts, seen, lambda batch, into, now=now: expected(batch, now.value, into))
        weights = (weights + RATE * np.clip(gradient / (obs + PRIOR), -2, 2)).astype(np.float32)
    return Model(head, weights, np.log10(np.maximum(mass, 1)), total, types), counts.where(~is_head).select("h", "c")


def score(docs: DataFrame, model: Model, rest: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, n_known, train_tokens (long), base_score, score (double: log10) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = F.col(text_col).cast("string")
    small_batches(docs.sparkSession)
    row = F.struct(F.xxhash64(F.col(id_col), text).alias("a"), F.xxhash64(F.lit(1), text, F.col(id_col)).alias("b"))
    slim = docs.select(F.col(id_col).alias("id"), row.alias("row"), text.alias("text"))

    def run(arrow):
        m: Model = shared.value
        none = len(m.head.hashes) - 1
        known = np.append(np.log10(m.head.counts[:-1] + 1), 0.0)
        for b in arrow:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                n_tok, n_head, logs, model_logs, tails, numbers = [], [], [], [], [], []
                for batch in batches(part.column(2).to_pylist(), m.head):
                    n_tok.append(np.diff(np.append(batch.starts, len(batch.at))))
                    n_head.append(np.add.reduceat((batch.at != none).astype(np.int64), batch.starts))
                    logs.append(np.add.reduceat(known[batch.at], batch.starts))
                    per = class_logs(batch, m.weights) / math.log(10) - m.shares[batch.classes]
                    model_logs.append(np.add.reduceat(per.astype(np.float64), batch.starts))
                    for h, a in zip(np.split(batch.hashes, batch.starts[1:]), np.split(batch.at, batch.starts[1:]), strict=True):
                        u, c = np.unique(h[a == none], return_counts=True)
                        tails.append(u.view(np.int64))
                        numbers.append(c.astype(np.int32))
                if n_tok:
                    cols = [part.column(0), part.column(1), *[pa.array(np.concatenate(x)) for x in (n_tok, n_head, logs, model_logs)]]
                    cols += [pa.array(tails, pa.list_(pa.int64())), pa.array(numbers, pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays(cols, ["id", "row", "n_tokens", "n_head", "logs", "model_logs", "tail", "number"])

    kind = slim.schema["id"].dataType.simpleString()
    scored = slim.mapInArrow(run, f"id {kind}, row struct<a:bigint,b:bigint>, n_tokens long, n_head long, logs double, model_logs double, tail array<long>, number array<int>")
    scored = cut(scored)
    apart = scored.select("row", F.explode(F.arrays_zip("tail", "number")).alias("t")).select("row", F.col("t.tail").alias("h"), F.col("t.number").alias("number")).distinct()
    extra = apart.join(rest, "h").groupBy("row").agg(F.sum("number").alias("more_known"), F.sum(F.col("number") * F.log10(F.col("c") + 1)).alias("more_logs"))
    all_ = scored.drop("tail", "number").join(extra, "row", "left")
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    return all_.select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("n_head") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * math.log10(model.tokens + model.types + 1)).alias("base_score"),
        (F.col("model_logs") + logs).alias("score"),
    )


def train_and_score(docs: DataFrame, training: Column, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, head_size: int = HEAD) -> DataFrame:
    """Fit on the rows where ``training`` is true (null: not), and score all rows."""
    texts = docs.where(F.coalesce(training, F.lit(False))).select(F.col(text_col).cast("string").alias("text"))
    model, rest = fit(texts, rounds, head_size)
    return score(docs, model, rest, id_col=id_col, text_col=text_col)
