"""Alignment against whole texts encoded by both libraries and a loop over byte offsets."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from vellum.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a   b ", "\n", "\n\na", "a\n b", "a \n b", "a\n\n \n b\t", "x  y", "tab\tand \t tab ", "it's don't 12½ 😀👩‍💻 日本語 한국어", "▁a ▁", "<s> </s> <unk> <0x41> <|endoftext|>",
    "é é ﬁ\x00z \x85 　 q r", "longwordlongwordlongword" * 300, "Ärger über Öl, niño año", "the the the the", "\x1c a", "a\r\nb \r c", "﻿bom",
]


def _brute(texts):
    a_tok, b_tok = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a_tok.encode_special_tokens = True
    shown = {}
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    shown = {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(rest)}
    vocabulary = {k: t for t, k in a_tok.get_vocab().items()}
    out, docs = [], defaultdict(set)
    for n, t in enumerate(texts):
        if not t:
            out.append(None)
            continue
        a, b = a_tok.encode(" " + t, add_special_tokens=False).ids, b_tok.encode(t)
        ab = [bytes(shown[c] for c in vocabulary[k]) for k in a]
        bb = [bytes([int(p[3:5], 16)]) if (p := b_tok.id_to_piece(k)).startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode() for k in b]
        if not b"".join(ab) == b"".join(bb) == (" " + t).encode():
            out.append(None)
            continue
        spans = []
        for ids, parts in ((a, ab), (b, bb)):
            at, own = 0, []
            for k, p in zip(ids, parts, strict=True):
                own.append((at, at + len(p), k))
                at += len(p)
            spans.append(own)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        low, groups = 0, []
        for c in cuts:
            groups.append("|".join(",".join(str(k) for s, e, k in own if low <= s and e <= c) for own in spans))
            low = c
        links = [(x, y) for s, e, x in spans[0] for u, v, y in spans[1] if s < v and u < e]
        for p in set(links):
            docs[p].add(n)
        out.append((len(a), len(b), ";".join(groups), links))
    counts = {p: len(d) for p, d in docs.items()}
    most = Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    rows = []
    for o in out:
        if o is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = o
            rows.append((n_a, n_b, groups.count(";") + 1, len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(groups.encode()).hexdigest()))
    return rows


@pytest.mark.parametrize("head", [1 << 18, 3, 0])
def test_alignment_equals_brute_force(spark, head):
    rnd = random.Random(head)
    words = ["token", "Über", "naïve,", "x1", "日本", "it's", "a\nb", "hydroxy", "\tq", "z."]
    texts = ODD + [rnd.choice(["", " ", "\n"]) + rnd.choice([" ", " ", "  ", "\n"]).join(rnd.choice(words) for _ in range(rnd.randint(1, 40))) for _ in range(60)] + ODD
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, row int, pairs string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in alignment.align(docs, A, B, head=head).collect()}
    for k, want in enumerate(_brute(texts)):
        assert got[k] == want, texts[k]


def test_pair_counts_and_groups(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a c")], "doc_id long, text string")
    linked = alignment.links(docs, A, B, groups=True)
    a, b, c = zip(*(t for t in (Tokenizer.from_file(A).encode(" a b c").ids, SentencePieceProcessor(model_file=B).encode("a b c"))), strict=True)
    assert [r.groups for r in linked.where("doc_id is null").collect()] == [f"{a[0]}|{a[1]};{c[0]}|{c[1]}"]
    counts = {(r.a, r.b): (r.n_docs, r.best) for r in alignment.pair_counts(linked, 32000).collect()}
    assert counts == {a: (3, True), b: (2, True), c: (1, True)}


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []
