"""The pipeline's stages against brute force, with odd rows and columns that carry the operators' own names; pages that go deep."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F
from test_llm import _line_brute

import corpus_pipeline
from vellum.llm import html_text, line_dedup, quality
from vellum.llm.common import table

NAMES = ["flags", "doc", "n_lines", "n_removed", "items", "n_words", "n_hit", "n_items", "spans", "key", "band", "root", "first", "least"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES)


def _docs(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *(f"{n} of {i}" for n in NAMES)) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def _carried(docs, out):
    """Whether the columns are those of the table, in its order and with its values."""
    assert out.columns == docs.columns
    for r in out.collect():
        assert [r[n] for n in NAMES] == [f"{n} of {r.doc_id}" for n in NAMES]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of a benchmark of two items and of labels."""
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([("q1", " ".join(f"item{k}" for k in range(20))), ("q2", "a short item"), (None, None)], "item_id string, text string").write.parquet(str(path / "benchmark.parquet"))
    spark.createDataFrame([(k, k % 2, 0) for k in range(80)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def _prose(rnd, n):
    return " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "zeta"]) + str(rnd.randrange(60)) for _ in range(n))


def test_line_stage(spark, folder):
    rnd = random.Random(1)
    lines = [_prose(rnd, 4) for _ in range(12)]
    texts = ["\n".join(rnd.choice(lines) for _ in range(4)) for _ in range(30)] + ["", None, " \n ", lines[0][:-1] + "x", lines[0] * 300]
    docs = _docs(spark, texts)
    out = corpus_pipeline.dedup_lines(spark, docs, folder)
    _carried(docs, out)
    want = _line_brute([t for t in texts if t is not None], [k for k, t in enumerate(texts) if t is not None])
    got = {r.doc_id: r.text for r in out.collect()}
    assert got.pop(31) is None and got == want
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())


def test_line_dedup_keeps_columns(spark):
    docs = _docs(spark, ["one line of text\none line of text", None, "one line of text"])
    out = line_dedup.dedup(docs.drop("n_lines", "n_removed"))
    assert sorted((r.doc_id, r.flags, r.doc, r.n_removed) for r in out.collect()) == [(0, "flags of 0", "doc of 0", 1), (1, "flags of 1", "doc of 1", 0), (2, "flags of 2", "doc of 2", 1)]


def test_near_stage(spark, folder):
    rnd = random.Random(2)
    texts, classes = [], []
    for c in range(12):
        base = _prose(rnd, 120).split()
        for k in range(rnd.randint(1, 4)):
            words = list(base)
            for _ in range(k):
                words[rnd.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
            classes.append(c)
    texts += ["", None, "word", texts[0]]
    docs = _docs(spark, texts)

    def shingled(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    sets, root = [shingled(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    out = corpus_pipeline.dedup_near(spark, docs, folder)
    _carried(docs, out)
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(root))


def test_decontamination_stage(spark, folder):
    rnd = random.Random(3)
    item = [f"item{k}" for k in range(20)]
    texts = [_prose(rnd, n) + " " + " ".join(item[s : s + m]) + ". " + _prose(rnd, n) for n in (10, 40, 200) for s, m in ((0, 20), (3, 13), (4, 12), (0, 14))]
    texts += ["A Short  ITEM", "not a short itemx", "", None, "!!", "x a-short,item " + _prose(rnd, 100)]

    def dirty(t):
        w = [x.lower() for x in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "") if x]
        hit = set()
        for win in [item[k : k + 13] for k in range(8)] + [["a", "short", "item"]]:
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
        return bool(hit) and 20 * len(hit) >= len(w)

    docs = _docs(spark, texts)
    out = corpus_pipeline.decontaminated(spark, docs, folder)
    _carried(docs, out)
    assert sorted(r.doc_id for r in out.collect()) == [k for k, t in enumerate(texts) if not dirty(t)]


def test_quality_stage(spark, folder):
    rnd = random.Random(4)
    texts = [_prose(rnd, 60) if k % 2 else " ".join(rnd.choice("zq xv jk".split()) for _ in range(60)) for k in range(100)] + ["", None]
    docs = _docs(spark, texts)
    out = corpus_pipeline.keep_quality(spark, docs, folder)
    _carried(docs, out)
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    voter = quality.fit(docs, table(spark, folder, "labels").where(learn))
    want = {r.doc_id for r in quality.score(docs, voter).collect() if r.score >= 0.3}
    kept = {r.doc_id for r in out.collect()}
    assert kept == want and {k for k in range(100) if k % 2} <= kept and not {k for k in range(100) if k % 2 == 0} & kept


def test_stages_on_empty_tables(spark, folder):
    docs = _docs(spark, [])
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, folder).collect() == [], name


def test_repeated_rows_and_rows_without_ids(spark, folder):
    texts = ["a line of some length\nanother line of text"] * 2 + ["quite another text that stands alone", "no id here at all"]
    docs = _docs(spark, texts, [1, 1, 2, None])
    assert sorted(str(r.doc_id) for r in corpus_pipeline.dedup_near(spark, docs, folder).collect()) == ["1", "1", "2", "None"]
    assert sorted(str(r.doc_id) for r in corpus_pipeline.decontaminated(spark, docs, folder).collect()) == ["1", "1", "2", "None"]
    assert sorted((str(r.doc_id), r.text) for r in corpus_pipeline.dedup_lines(spark, docs, folder).collect()) == sorted((str(i), t) for i, t in zip([1, 1, 2, None], texts, strict=True))
    assert all(r.round_trip for r in corpus_pipeline.encoded(spark, docs, folder).collect())


N = 1_000_000
DEEP = {
    "lists": "<ul><li>" * (N // 8), "unclosed": "<div>" * (N // 5), "crossed": "<div>" * (N // 9) + "</x>" * (N // 9), "declarations": "<!" * (N // 2), "inline": "<i hidden>" * (N // 21) + "<div></div>" * (N // 21),
    "named inline": '<i class="ad">' * (N // 14), "scripts": "<script" * (N // 7), "quotes": '<a b="' * (N // 6), "closing": "</script" * (N // 8), "tables": "<table><tr><td>x" * (N // 16), "bare": "<" * N,
}


@pytest.mark.parametrize("kind", DEEP)
def test_pages_take_time_in_proportion(kind):
    began = time.process_time()
    html_text.main_text(DEEP[kind], None)
    assert time.process_time() - began < 20


def test_article_below_many_elements():
    page = "<html><body>" + "<div>" * 400 + "<article><p>the text</p></article><p>beside</p>"
    assert html_text.main_text(page, None) == "the text"
    assert html_text.main_text("<html><body>" + "<div>" * 400 + "<p>no article</p>", None) == "no article"
