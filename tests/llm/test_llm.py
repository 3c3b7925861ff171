"""The corpus operators against brute force, exact round trips and held-out accuracy, on small fixtures with odd rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from vellum.llm import bpe, decontaminate, fm_index, html_text, line_dedup, maxent_lm, media, quality, queries, simhash, substring_dedup, token_counts

RANKS = public_tokenizers.path(queries.RANKS)
SCHEMA = "doc_id long, text string, fp string, key string, a string, th string"  # columns whose names operators use themselves


def _docs(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "x", "y", "z", "w") for i, t in zip(ids, texts, strict=True)], SCHEMA)


def _texts(seed=7, n=60):
    """Prose with copies, near copies, repeated passages, a null, empty, blank and a long text."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(2, 7))) for _ in range(150)]
    prose = lambda k: " ".join(rnd.choice(vocabulary) for _ in range(k))
    passage = prose(60)
    out = ["\n".join(prose(rnd.randint(3, 40)) for _ in range(rnd.randint(1, 5))) for _ in range(n)]
    out += [out[0], out[0], out[1] + "!", out[2].replace(" ", "  ", 1), passage, prose(20) + " " + passage + " " + prose(9), passage + "\n" + passage]
    return [*out, None, "", "  \n ", "a", prose(3000), "THE " * 80]


def _tiktoken():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def test_bpe_equals_tiktoken(spark):
    texts = [*_texts(), "a  b\t\n c   d's 12 <|endoftext|> 日本 😀\r\n", " \n \n x"]
    want = _tiktoken()
    got = bpe.encode(_docs(spark, texts), RANKS, public_tokenizers.PATTERN, decoded=True).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r.doc_id] or ""
        assert list(memoryview(bytes(r.ids)).cast("I")) == want.encode_ordinary(t)
        assert bytes(r.decoded) == t.encode() and r.n_tokens == len(r.ids) // 4


def test_bpe_equals_tiktoken_at_white_space():
    import tiktoken

    texts = ["x ", "x  ", "x\n ", "x\t ", " ", "  ", "   ", "x y  ", "x\u00a0 "]
    texts += ["".join(p) for n in range(1, 6) for p in itertools.product("x \n\t1!", repeat=n)]
    own = bpe.load_ranks(RANKS)  # has no token of several white characters, so ids alone do not show where matches end
    for more in ([], [b"  ", b"\n ", b"\t ", b" \n", b"   "]):
        ranks = {**own, **{t: len(own) + k for k, t in enumerate(more)}}
        want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        got = bpe.Encoder(ranks, public_tokenizers.PATTERN).encode(texts)
        assert [t for t, ids in zip(texts, got, strict=True) if list(memoryview(ids).cast("I")) != want.encode_ordinary(t)] == []


def test_merge_replay_order_inside_words():
    """Vocabularies in which a merge makes way for one of lower rank."""
    rnd = random.Random(1)
    for _ in range(60):
        pieces = list({bytes(rnd.choice(b"ab ") for _ in range(rnd.randint(2, 5))) for _ in range(30)})
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + k for k, t in enumerate(pieces)}
        m = bpe.MergeReplay(ranks)
        words = [bytes(rnd.choice(b"ab ") for _ in range(rnd.randint(1, 14))) for _ in range(40)]
        assert m.encode(words) == [ranks[w].to_bytes(4, "little") if w in ranks else m.alone(w) for w in words]


def test_token_counts_encode_once(spark):
    encoded = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            encoded.add(b.num_rows)
            yield b

    hist = spark.createDataFrame([(3, 2), (5, 1)], "n_tokens long, n_docs long").mapInArrow(count, "n_tokens long, n_docs long")
    assert token_counts.suffix_sums(hist).count() == 2 and len(token_counts.suffix_sums(hist).collect()) == 2
    assert encoded.value == 4


def test_token_counts(spark):
    texts = _texts()
    lengths = sorted(len(_tiktoken().encode_ordinary(t or "")) for t in texts)
    sums = token_counts.suffix_sums(token_counts.histogram(_docs(spark, texts), RANKS, public_tokenizers.PATTERN))
    got = {r.context_limit: r for r in sums.collect()}
    assert sorted(got) == sorted(set(lengths))
    for limit, r in got.items():
        assert r.truncated_total == sum(min(limit, x) for x in lengths) and r.docs_at_least == sum(x >= limit for x in lengths)
        assert r.tokens_at_least == sum(x for x in lengths if x >= limit) and r.quantile == sum(x <= limit for x in lengths) / len(lengths)
    limits = [0, 5, 777, 10**6]
    assert {r.context_limit: r.truncated_total for r in token_counts.truncated_total(sums, limits).collect()} == {k: sum(min(k, x) for x in lengths) for k in limits}


def _line_brute(texts, ids, threshold=1, least=10):
    def within(a, b):
        if abs(len(a) - len(b)) > threshold:
            return False
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1] <= threshold

    seen: list[str] = []
    kept = {}
    for i, t in sorted(zip(ids, texts, strict=True)):
        if t is None:
            continue
        stay = []
        for line in t.split("\n"):
            blank = not line.strip(" ")
            if blank or not any(line == s or len(line) >= least and len(s) >= least and within(line, s) for s in seen):
                stay.append(line)
            if not blank:
                seen.append(line)
        kept[i] = "\n".join(stay)
    return kept


@pytest.mark.parametrize("hot", [64, 1])
def test_line_dedup(spark, hot):
    rnd = random.Random(3)
    lines = ["".join(rnd.choice("abé ") for _ in range(rnd.randint(8, 16))) for _ in range(25)]

    def edit(s):
        i = rnd.randrange(len(s))
        return rnd.choice([s[:i] + rnd.choice("abc") + s[i + 1 :], s[:i] + s[i + 1 :], s[:i] + "c" + s[i:], s])

    texts = ["\n".join(edit(rnd.choice(lines)) for _ in range(rnd.randint(1, 6))) for _ in range(60)]
    texts += [None, "", "\n\n", "x", "x", texts[0], "order number 00000" + "\n" + "\n".join(f"order number {k:05d}" for k in range(40))]
    ids = list(range(len(texts)))
    got = {r.doc_id: r for r in line_dedup.dedup(_docs(spark, texts), hot=hot).collect()}
    want = _line_brute(texts, ids)
    assert {i: r.text for i, r in got.items() if r.text is not None} == want
    assert got[60].text is None and (got[60].n_lines, got[60].n_removed) == (0, 0)
    assert all(r.n_lines - r.n_removed == (len(want[i].split("\n")) if want[i] or texts[i].split("\n")[0] == "" else 0) for i, r in got.items() if i in want and r.n_removed < r.n_lines)


def test_within_equals_levenshtein(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abé") for _ in range(rnd.randint(0, 9)))
    d = spark.createDataFrame([(word(), word()) for _ in range(1500)], "a string, b string")
    for k in (1, 2, 3):
        assert d.where(line_dedup.within(F.col("a"), F.col("b"), k) != (F.levenshtein("a", "b") <= k)).count() == 0


def _fingerprint(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    texts = _texts()
    texts += [texts[70][:-6] if texts[70] else "q", *[f"{texts[71]} {k}" for k in range(30)]]
    fps = [_fingerprint(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = {r.doc_id: (r.fp % 2**64, r.component) for r in simhash.classes(_docs(spark, texts)).collect()}
    assert got == {i: (fps[i], root(i)) for i in range(len(texts))}


def test_simhash_links_every_radius(spark):
    rnd = random.Random(2)
    base = [rnd.getrandbits(64) for _ in range(6)]
    values = sorted({b ^ sum(1 << x for x in rnd.sample(range(64), k)) for b in base for k in (0, 1, 1, 2, 2, 3)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    d = spark.createDataFrame([(v,) for v in signed], "fp long")
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= 1}
    assert {(r.u, r.v) for r in simhash.links(d, 1).collect()} == want


def _jaccard(a, b):
    sets = []
    for t in (a, b):
        w = (t or "").lower().split()
        sets.append({" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_dedup_finds_planted_copies(spark):
    import corpus_pipeline

    rnd = random.Random(4)
    vocabulary = ["".join(rnd.choice("abcdefg") for _ in range(6)) for _ in range(3000)]
    texts, want, apart = [], set(), set()
    for k in range(60):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(150, 500))]
        copy = list(words)
        goal = 0.8 + 0.15 * k / 60 if k < 50 else 0.7
        order = rnd.sample(range(len(words)), len(words))
        while _jaccard(" ".join(words), " ".join(copy)) > goal:
            before = list(copy)
            copy[order.pop()] = "changed"
        texts += [" ".join(words), " ".join(before if k < 50 else copy)]
        (want if k < 50 else apart).add(2 * k + 1)
    assert all(0.8 <= _jaccard(texts[i - 1], texts[i]) <= 0.97 for i in want)
    # the copies of one text that differ from it and from each other in single words are one class
    texts += [" ".join([f"w{k}" if k == j else "same%d" % k for k in range(200)]) for j in range(40)]
    extra = set(range(121, 160))
    kept = {r.doc_id for r in corpus_pipeline.dedup_near(spark, _docs(spark, [*texts, None, "", " "]), "").collect()}
    assert set(range(163)) - kept == want | extra | {161, 162}


@pytest.mark.parametrize("tile", [(512, 8 << 20), (2, 1 << 20), (512, 300)])
def test_verified_classes_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile[0])
    monkeypatch.setattr(simhash, "TILE_BYTES", tile[1])
    texts = _texts()
    texts += [texts[0] + " and one more", *[f"{texts[71]} {k}" for k in range(30)]]
    # a family of near copies, most of which are further from each other than the similarity asked for
    rnd = random.Random(9)
    for _ in range(40):
        words = [f"family{k}" for k in range(150)]
        for k in rnd.sample(range(150), rnd.choice([1, 2, 3, 3, 3])):
            words[k] = f"edit{rnd.random()}"
        texts.append(" ".join(words))
    least = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if _jaccard(texts[i], texts[j]) >= 0.8 and least[i] != least[j]:
                a, b = sorted((least[i], least[j]))
                least = [a if x == b else x for x in least]
    assert {r.doc_id: r.component for r in simhash.verified_classes(_docs(spark, texts)).collect()} == dict(enumerate(least))


def test_fm_index():
    rnd = random.Random(1)
    for _ in range(80):
        w = rnd.choice([2, 3, 5, 8])
        segments = [np.array([rnd.randint(1, 3) for _ in range(rnd.randint(w, 14))]) for _ in range(rnd.randint(1, 12))]
        copies = np.array([rnd.choice([1, 1, 2]) for _ in segments])
        c = Counter()
        for s, k in zip(segments, copies, strict=True):
            for i in range(len(s) - w + 1):
                c[tuple(s[i : i + w])] += k
        want = [[i for i in range(len(s) - w + 1) if c[tuple(s[i : i + w])] > 1] for s in segments]
        assert [x.tolist() for x in fm_index.repeated_windows(segments, copies, w)] == want


@pytest.mark.parametrize("options", [{}, {"hot": 2, "shard_words": 300}])
def test_substring_dedup(spark, options):
    texts = _texts()
    passage = texts[64]
    texts += [f"w{k} {passage} v{k % 3}" for k in range(30)]  # more places of a segment in a task than go to its shard
    c = Counter()
    for t in texts:
        w = (t or "").encode().split()
        c.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(_docs(spark, texts), **options).collect()}
    for i, t in enumerate(texts):
        w = (t or "").encode().split()
        gone = {j for s in range(len(w) - 34) if c[tuple(w[s : s + 35])] > 1 for j in range(s, s + 35)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        assert (got[i].n_words, got[i].n_removed, bytes(got[i].kept)) == (len(w), len(gone), kept)


def test_media(spark):
    texts = [*_texts(), "x" * 192, "x" * 193]
    got = media.media_columns(_docs(spark, texts)).collect()
    seen = defaultdict(set)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        padded = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        assert bytes(r.payload) == padded == media.read_wav(bytes(r.media)) and r.n_bytes == len(raw)
        assert len(r.fp_time) == len(r.fp_code) and r.fp_time == sorted(r.fp_time)
        seen[padded].add((bytes(r.media), tuple(r.fp_code)))
    assert all(len(v) == 1 for v in seen.values())


def test_media_features_equal_brute_force():
    """Peaks by a transform written out, pairs by loops."""
    rnd = random.Random(2)
    for text in (b" " * 192, b"abc" * 300, bytes(rnd.randrange(32, 127) for _ in range(192 * 23)), bytes(rnd.choice(b"aZ") for _ in range(192 * 60))):
        x = np.frombuffer(text, np.uint8).astype(np.float32) - 128
        n = max(1, -(-(len(x) - 384) // 192) + 1)
        x = np.append(x, np.zeros((n - 1) * 192 + 384 - len(x), np.float32))
        turn = np.exp(-2j * np.pi * np.outer(np.arange(193), np.arange(384)) / 384)
        top = []
        for f in range(n):
            frame = x[f * 192 : f * 192 + 384]
            power = np.abs(turn @ ((frame - frame.mean()) * np.hanning(384).astype(np.float32))) ** 2
            top.append([(lo + int(power[lo:hi].argmax()), float(power[lo:hi].max())) for lo, hi in ((2, 12), (12, 32), (32, 80), (80, 193))])
        bins, power = media.peaks(text)
        strong = np.array([[p > 1 for _, p in t] for t in top])
        assert (bins[strong] == np.array([[b for b, _ in t] for t in top])[strong]).all()
        assert np.allclose(power, np.array([[p for _, p in t] for t in top]), rtol=1e-3, atol=0.1)
        want = []
        for band in range(4):
            kept = [f for f in range(n) if power[f, band] > 1 and all(power[f, band] >= power[g, band] for g in (f - 1, f + 1) if 0 <= g < n)]
            for i, f in enumerate(kept):
                later = [g for g in kept[i + 1 : i + 3] if g - f <= 32]
                want += [(f, int(bins[f, band]) << 16 | int(bins[g, band]) << 8 | g - f) for g in later]
                if i + 1 == len(kept) or kept[i + 1] - f > 32:
                    want.append((f, int(bins[f, band]) << 16))
        assert sorted(want) == list(zip(*(c.tolist() for c in media.fingerprint(text)), strict=True))


def test_quality_votes_equal_brute_force():
    rnd = np.random.default_rng(5)
    x = np.abs(rnd.normal(size=(80, quality.DIMS))).astype(np.float32) * (rnd.random((80, quality.DIMS)) < 0.02)
    y = (rnd.random(80) < 0.6).astype(np.float32)
    voter = quality.Voter(x[:60], y[:60], latent=8, neighbours=5)
    idf = np.log(61 / (1 + (x[:60] > 0).sum(axis=0))) + 1
    unit = lambda m: m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-30)
    w = unit(x.astype(np.float64) * idf)
    right = np.linalg.svd(w[:60], full_matrices=False)[2][:8]
    v = unit(w @ right.T)
    for k, got in enumerate(voter.score(x, block=7)):
        cosine = v[:60] @ v[k]
        near = np.argsort(-cosine)[:5]
        weight = np.maximum(cosine[near], 0) ** 8
        assert abs(got - (weight @ y[near]) / weight.sum()) < 1e-3


def test_decontamination(spark):
    rnd = random.Random(4)
    words = [w for w in "the of alpha beta gamma delta epsilon zeta eta theta iota kappa É9 naïve x1".split()]
    prose = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    items = [prose(25), prose(13), prose(5), "Zeta, ALPHA!", None, "", "...", "É9 naïve"]
    items.append(items[1])
    texts = [prose(rnd.randint(0, 60)) for _ in range(30)] + [f"{prose(3)} {items[0].upper()}; {prose(200)}", items[1] + " x", "zeta alpha", "é9 naïve", None, "", "!!"]
    import re

    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t or ""))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contained(_docs(spark, texts), bench).collect()}
    for i, t in enumerate(texts):
        w, hit, found = split(t), set(), set()
        for k, item in enumerate(items):
            v = split(item)
            n = min(13, len(v))
            for s in range(len(v) - n + 1) if v else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit |= set(range(p, p + n))
                        found.add(str(k))
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, list(got[i].items)) == (len(w), len(hit), len(found), sorted(found)), t


def test_maxent_lm(spark):
    rnd = random.Random(9)
    cycle = "alpha beta gamma delta epsilon zeta eta theta".split()
    texts = [" ".join((cycle * 6)[(s := rnd.randrange(8)) : s + rnd.randint(5, 30)]) for _ in range(120)] + [None, "", "unseen words only", "ALPHA beta"]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    toks = [maxent_lm.tokens(t) for t in texts]
    c = Counter(w for t, h in zip(toks, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    for size in (maxent_lm.HEAD, 4):
        rows = maxent_lm.train_and_score(_docs(spark, texts), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, head_size=size).collect()
        base = model = 0.0
        for r in rows:
            want = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks[r.doc_id])
            assert abs(r.base_score - want) < 1e-9 * max(1, -want)
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(toks[r.doc_id]), sum(c[w] > 0 for w in toks[r.doc_id]), n)
            assert r.score < 0
            if held[r.doc_id]:
                base, model = base + want, model + r.score
        assert model > base if size > 4 else True  # the context tells the next word


def test_maxent_lm_sums_equal_brute_force(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("alpha beta gamma delta Eps. zeta,".split()) for _ in range(rnd.randint(0, 30))) for _ in range(40)]
    c = Counter(w for t in texts for w in maxent_lm.tokens(t))
    head = maxent_lm.Head(np.array([xxhash.xxh64_intdigest(w) for w in c if w != b"zeta,"], np.uint64), np.array([n for w, n in c.items() if w != b"zeta,"]))
    seen, exp = np.zeros((maxent_lm.CLASSES, maxent_lm.ROWS)), np.zeros((maxent_lm.CLASSES, maxent_lm.ROWS))
    weights = np.random.default_rng(0).normal(size=seen.T.shape).astype(np.float32)
    got = list(maxent_lm.batches(texts, head))
    for b in got:
        maxent_lm.observed(b, seen)
        maxent_lm.expected(b, weights, exp)
    want_seen, want_exp = np.zeros_like(seen), np.zeros_like(exp)
    for b in got:
        for k, r in enumerate(b.rows.T):
            rows = [*r.tolist(), maxent_lm.ROWS - 1]
            z = weights[rows].astype(np.float64).sum(axis=0)
            p = np.exp(z) / np.exp(z).sum()
            assert abs(maxent_lm.class_logs(b, weights)[k] - math.log(p[b.classes[k]])) < 1e-4
            for row in rows:
                want_seen[b.classes[k], row] += 1
                want_exp[:, row] += p
    assert (seen == want_seen).all() and np.abs(exp - want_exp).max() < 1e-4
    d = spark.createDataFrame([(t,) for t in texts], "text string").repartition(40)
    for level in (1, 16):
        maxent_lm.LEVEL, old = level, maxent_lm.LEVEL
        assert (maxent_lm._summed(d, spark.sparkContext.broadcast(head), maxent_lm.observed) == want_seen.T).all()
        maxent_lm.LEVEL = old


def test_maxent_lm_company_equals_brute_force(spark):
    """Neighbours counted by loops; words of two languages that never meet come into classes of their own."""
    rnd = random.Random(8)
    tongues = [([f"{c}f{k}" for k in range(4)], [f"{c}w{k}" for k in range(30)]) for c in "xy"]
    texts = [" ".join(rnd.choice(w) for _ in range(40) for w in tongues[k % 2]) for k in range(80)] + [None, ""]
    c = Counter(w for t in texts for w in maxent_lm.tokens(t))
    head = maxent_lm.Head(np.array([xxhash.xxh64_intdigest(w) for w in c], np.uint64), np.array(list(c.values())))
    place = {w: int(np.flatnonzero(head.hashes == xxhash.xxh64_intdigest(w))[0]) for w in c}
    want = np.zeros((maxent_lm.SHAPED, 2 * maxent_lm.COMPANY))
    for t in texts:
        for a, b in itertools.pairwise(maxent_lm.tokens(t)):
            if place[a] < maxent_lm.COMPANY:
                want[place[b], place[a]] += 1
            if place[b] < maxent_lm.COMPANY:
                want[place[a], maxent_lm.COMPANY + place[b]] += 1
    d = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = maxent_lm._summed(d, spark.sparkContext.broadcast(head), maxent_lm.company, maxent_lm.SHAPED, 2 * maxent_lm.COMPANY)
    assert (got == want).all()
    head.classed(got)
    classes = [{int(head.classes[place[w]]) for w in map(str.encode, words)} for _, words in tongues]
    assert not classes[0] & classes[1]


def test_maxent_lm_is_a_distribution(spark):
    """Over the known tokens and one unknown of each class outside the head, the probabilities sum to one."""
    texts = spark.createDataFrame([("a b c a b d",), ("b a",), ("e f g.",)], "text string")
    model, _ = maxent_lm.fit(texts)
    counts = Counter(w for r in texts.collect() for w in maxent_lm.tokens(r.text))
    batch = next(maxent_lm.batches(["a"], model.head))
    z = maxent_lm._logits(model.weights, batch.rows)[:, 1]
    p_class = np.exp(z) / np.exp(z).sum()
    total = sum(p_class[k] * (model.head.counts[i] + 1) / 10 ** model.shares[k] for i, k in enumerate(model.head.classes[:-1]))
    tails = range(maxent_lm.OWN + maxent_lm.KINDS, maxent_lm.CLASSES)
    total += sum(p_class[k] / 10 ** model.shares[k] for k in tails)
    total += sum(p_class[k] for k in set(range(tails.start)) - set(model.head.classes[:-1].tolist()))
    assert len(model.head.hashes) - 1 == len(counts) and abs(total - 1) < 1e-5


def test_quality_held_out():
    rnd = random.Random(6)
    good = lambda: " ".join("".join(rnd.choice("aeiost") for _ in range(rnd.randint(2, 8))) for _ in range(60)).capitalize() + "."
    bad = lambda: rnd.choice([lambda: good().upper().replace(" ", "!! "), lambda: good().replace(" ", "### "), lambda: "Buy " * 50])()
    rows = [(bad(), 0) if rnd.random() < 0.2 else (good(), 1) for _ in range(500)]
    cache = quality.Features()
    x = np.stack([quality.features(t, cache) for t, _ in rows])
    y = np.array([k for _, k in rows], np.float32)
    voter = quality.Voter(x[:300], y[:300])
    assert ((voter.score(x[300:]) >= 0.3) == y[300:]).mean() > 0.97
    odd = voter.score(np.stack([quality.features(t, cache) for t in (None, "", "x" * 100_000)]))
    assert ((odd >= 0) & (odd <= 1)).all()
    assert quality.Voter(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


def _page(body):
    return f"<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><ul><li><a href='/'>Home</a></ul></nav><div class='ad'>Buy now</div>{body}<footer>&copy; 2020</footer></body></html>"


def test_html_text(spark):
    rnd = random.Random(8)
    words = lambda k: " ".join(rnd.choice(["one", "two", "three", "four"]) for _ in range(k))
    pages, want = [], []
    for k in range(12):
        parts = [words(rnd.randint(3, 30)) for _ in range(rnd.randint(1, 4))]
        inner = "".join(f"<p>{p} &amp;  <b>x</b>\n y" for p in parts)
        # a site without article elements: the template's main element is the content's division
        pages.append(("http://a.example/%d" % k, _page(f"<div id='wrap'><div class='content'><h1>T{k}</h1>{inner}</div><div class='comments'><p>{words(40)}</p></div></div>")))
        want.append("\n".join([f"T{k}", *[f"{p} & x y" for p in parts]]))
    pages += [("http://b.example/x", _page("<article><p>Alone<p>here</article>")), (None, None), ("http://c.example", ""), ("http://d.example", "<p>un<br>closed <b>text"), ("http://e.example", "a < b & c")]
    want += ["Alone\nhere", "", "", "un closed text", "a < b & c"]
    d = spark.createDataFrame([(i, u, h, "q", "r") for i, (u, h) in enumerate(pages)], "page_id long, url string, html string, host string, main string")
    got = {r.page_id: r for r in html_text.extract(d).collect()}
    assert [got[i].text for i in range(len(want))] == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_html_template_equals_brute_force(spark):
    """Classes of a small site by whole occurrence vectors, its fixed texts, slots and nesting."""
    rnd = random.Random(3)
    pages = []
    for k in range(10):
        items = "".join(f"<p>{'own text %d %d ' % (k, j) * 5}</p>" for j in range(rnd.randint(1, 4)))
        promo = "<section><p>Subscribe for more</p></section>"  # fixed text with no telling name
        side = f"<div class='related-links'><p>See {k}</p></div>" if k % 2 else ""
        pages.append(f"<body><div id='top'><p>Site name</p></div><div class='page has-sidebar'><div class='text'><h2>Story</h2>{items}{promo}</div>{side}</div></body>")
    d = spark.createDataFrame([(k, f"http://h.example/{k}", p) for k, p in enumerate([*pages, pages[0]])], "page_id long, url string, html string")
    count, path_of = defaultdict(Counter), {}
    for k, p in enumerate([*pages, pages[0]]):
        for event in html_text.walk(p):
            if event[0] == "open":
                count[event[1], 0][k] += 1
            elif event[0] == "text" and event[2].strip():
                key = html_text.key_of(event[1].path, event[2].strip()) | 1
                count[event[1].path, key][k] += 1
    classes = defaultdict(set)
    for token, vector in count.items():
        if len(vector) >= 0.9 * 11:
            classes[tuple(sorted(vector.items()))].add(token)
    template, main = html_text.templates(d)
    rows = template.collect()
    got = defaultdict(set)
    for r in rows:
        got[r["class"]].add((r.path, r.text))
    assert sorted(map(sorted, got.values())) == sorted(sorted(c) for c in classes.values() if len(c) > 1)
    top = "/body/div.has-sidebar.page"
    assert {r.path for r in rows if r.text == 0 and r.once} == {"/body", "/body/div#top", "/body/div#top/p", top, f"{top}/div.text", f"{top}/div.text/h2", f"{top}/div.text/section", f"{top}/div.text/section/p"}
    assert main.first().main == f"{top}/div.text"
    texts = {r.page_id: r.text for r in html_text.extract(d).collect()}
    for k, p in enumerate(pages):
        import re

        assert texts[k] == "\n".join(x.strip() for x in re.findall("own text [^<]*", p)), k  # neither "Story" nor the promo


def test_html_furniture_is_confirmed():
    text = lambda body, **k: html_text.main_text(f"<html><body>{body}</body></html>", None, **k)
    long = "words of an article " * 5
    assert text(f"<article><section id='search-algorithms'><p>{long}</p></section></article>") == long.strip()
    assert text(f"<article class='has-sidebar'><div class='related-work'><p>{long}</p></div></article>") == long.strip()
    assert text(f"<article><p>{long}</p><span class='ad'><span>x</span>LEAK</span><p>end</p></article>") == long.strip() + "\nend"
    assert text(f"<article><p>{long}<span class='ad'>LEAK<b>y</b></span> tail</p><div class='social share'>Tweet</div></article>") == long.strip() + " tail"
    assert text(f"<article><p>{long}</p><div class='comments'><p>reader</p></div></article>") == long.strip()
    assert text("<div>" * 300 + "<article><p>deep</p></article>") == "deep"
    assert html_text.main_text("<p>a <img src=data:" + "x" * 200_000 + "> b</p><p>c <a href='", None) == "a b\nc"
    assert html_text.main_text("<a <a <a" * 20_000 + "<", None) == ""


def test_html_copies_keep_their_text(spark):
    """Pages that are copies of one article have no text of their own left; theirs stays."""
    page = lambda k: f"<body><div class='m'><p>One text</p><p>for all of them</p></div><p>{k}</p></body>"
    d = spark.createDataFrame([(k, "http://c.example/x", page(k % 4)) for k in range(8)], "page_id long, url string, html string")
    assert {r.text for r in html_text.extract(d).collect() if "One text" not in r.text} == set()


def test_empty_tables(spark):
    none = _docs(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    found = [
        html_text.extract(pages),
        token_counts.suffix_sums(token_counts.histogram(none, RANKS, public_tokenizers.PATTERN)),
        line_dedup.dedup(none),
        bpe.encode(none, RANKS, public_tokenizers.PATTERN),
        simhash.classes(none),
        maxent_lm.train_and_score(none, F.lit(True)),
        substring_dedup.remove_repeats(none),
        media.media_columns(none),
        quality.score(none, quality.fit(none, spark.createDataFrame([], "doc_id long, quality int"))),
        decontaminate.contained(none, bench),
    ]
    assert [d.count() for d in found] == [0] * len(found)
    assert decontaminate.contained(_docs(spark, ["a b", None]), bench).where("n_hit > 0").count() == 0


def test_repeated_rows_and_null_ids(spark):
    d = _docs(spark, ["same text here and more", "same text here and more", "other", None], [5, 5, None, None])
    bench = spark.createDataFrame([(1, "other")], "item_id long, text string")
    assert simhash.classes(d).count() == 4 and line_dedup.dedup(d).count() == 4 and substring_dedup.remove_repeats(d).count() == 4
    assert decontaminate.contained(d, bench).where("n_hit = 1").count() == 1
    assert maxent_lm.train_and_score(d, F.lit(True)).count() == 4


def test_pipeline(spark):
    import corpus_pipeline
    from conftest import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.keep_quality(spark, docs, SF)
    assert kept.columns == docs.columns
    lines = corpus_pipeline.dedup_lines(spark, kept, SF)
    assert lines.count() == kept.count() and lines.columns == docs.columns
    texts = {r.doc_id: r.text for r in lines.collect()}
    source = {r.doc_id: r.text for r in kept.collect()}
    assert texts == _line_brute(list(source.values()), list(source)) if sum(map(len, source.values())) < 20_000 else all(len(texts[i]) <= len(source[i]) for i in texts)
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert rows and all(r.round_trip and r.n_tokens == len(r.ids) // 4 for r in rows)
    assert len({r.doc_id for r in rows}) == len(rows) and {r.doc_id for r in rows} <= set(texts)


def test_digests(spark):
    from conftest import SF

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op4_bpe(spark, SF).collect():
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
