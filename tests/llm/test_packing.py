"""Packing against the tokenizer itself: every id in one piece, windows without gaps, little padding."""

from __future__ import annotations

import random
import zlib
from array import array
from collections import defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from vellum.llm import packing
from vellum.llm.chunks import ChunkCache
from vellum.llm.queries import WORDS

PATH = public_tokenizers.path(WORDS)
ODD = [None, "", " \n\t ", "a", "İstanbul ΣΑΣ ﬁ é ́x <|endoftext|> it's 12 3½ \x1c\x85z", "x" * 3000, "日本 語\n😀 👩‍💻", "<|startoftext|>", "a b  c\r\n d"]


def _want(texts, end):
    t = Tokenizer.from_file(PATH)
    return [array("I", [*t.encode(x or "", add_special_tokens=False).ids, end]).tobytes() for x in texts]


@pytest.mark.parametrize("size,open_windows,group,parts", [(64, 3, 2, 7), (4096, 64, 64, 4), (16, 1, 3, 9)])
def test_every_id_lies_in_one_piece(spark, size, open_windows, group, parts):
    rnd = random.Random(size)
    texts = ODD + [" ".join(rnd.choice(["foo", "Bar,", "it's", "éß", "12"]) for _ in range(rnd.randint(0, 120))) for _ in range(200)] + ["word " * 4000] + ODD
    docs = spark.createDataFrame([(k, t, 0, "x") for k, t in enumerate(texts)], "doc_id long, text string, start int, ids string").repartition(parts)
    rows = packing.pack(docs, PATH, end=2, size=size, open_windows=open_windows, group=group, ids=True).collect()
    want, pieces, windows = _want(texts, 2), defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) // 4 > 0 and r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.doc_tokens == len(want[r.doc_id]) // 4
        pieces[r.doc_id].append((r.start, bytes(r.ids)))
        windows[r.sequence_id].append((r.offset, r.length))
    for k, ids in enumerate(want):
        at = 0
        for start, part in sorted(pieces[k]):
            assert start == at
            at += len(part) // 4
        assert b"".join(p for _, p in sorted(pieces[k])) == ids
    for ps in windows.values():
        at = 0
        for offset, length in sorted(ps):
            assert offset == at
            at += length
        assert at == size or at < size and at & (at - 1) == 0  # no window needs padding


def test_chunks_have_the_tokenizers_ids():
    rnd = random.Random(3)
    alphabet = "aAzZ'sStTrReEvVmMlLdD09.,-<|>éÉßÀÿªº½²_´¨İΣ\u0301 "
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 14))) for _ in range(20_000)] + ODD
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    with open(PATH, encoding="utf-8") as f:
        got = [ids for _, ids in packing.encoded([batch], f.read(), 2)]
    assert [t for t, w, g in zip(texts, _want(texts, 2), got, strict=True) if w != g] == []


def test_sequences(spark):
    docs = spark.createDataFrame([(1, "a b c"), (None, None), (1, "a b c")], "doc_id long, text string")
    pieces = packing.pack(docs, PATH, end=2, size=8, ids=True)
    assert sorted((r.doc_id is None, r.doc_tokens) for r in pieces.where("start = 0").collect()) == [(False, 4), (False, 4), (True, 1)]
    got = packing.sequences(pieces, size=8, pad=7).collect()
    assert sorted(r.n_tokens for r in got) == [1, 8] and all(len(r.ids) == 4 * r.n_tokens for r in got)
    padded = packing.sequences(spark.createDataFrame([(0, 0, 3, b"abcd" * 3)], "sequence_id long, offset long, length long, ids binary"), size=8, pad=7).first()
    assert bytes(padded.ids) == b"abcd" * 3 + (7).to_bytes(4, "little") * 5


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH, end=2).collect() == []


def test_chunk_cache_keeps_what_is_in_use():
    made = []
    cache = ChunkCache(lambda cs: [made.append(c) or c.upper() for c in cs], 2)
    for k in range(6):
        got = cache.of({"often", f"once{k}", "y" * 300})
        assert got["often"] == "OFTEN" and got["y" * 300] == "Y" * 300
    assert made.count("often") == 1 and len(cache.young) + len(cache.old) <= 8 and made.count("y" * 300) == 6
