"""Cross-tokenizer alignment against a plain version that works text by text."""

from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import public_tokenizers as tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from listflow.llm.alignment import ByteLevel, align_tokens
from listflow.llm.common import table
from listflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
A, B = tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model")


def plain_tokens(texts):
    """Per text, (id, start, end) of A and of B, or None."""
    a_side, b_side = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_side.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    out = []
    for text in texts:
        if not text:
            out.append(None)
            continue
        found = a_side.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(back[c] for c in t)) for i, t in zip(found.ids, found.tokens)]
        ids = b_side.encode(text)
        b = [(i, bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode()) for i, p in zip(ids, map(b_side.id_to_piece, ids))]
        both = []
        for side in (a, b):
            at, spans = 0, []
            for i, token in side:
                spans.append((i, at, at + len(token)))
                at += len(token)
            both.append(spans)
        whole = (" " + text).encode()
        out.append(both if b"".join(t for _, t in a) == whole == b"".join(t for _, t in b) else None)
    return out


def brute(texts):
    found = plain_tokens(texts)
    links, docs = [], collections.Counter()
    for both in found:
        own = []
        if both:
            for i, s, e in both[0]:
                own += [(i, j) for j, u, v in both[1] if u < e and s < v] if len(both[0]) < 400 else []
            if len(both[0]) >= 400:
                k = 0
                for i, s, e in both[0]:
                    while both[1][k][2] <= s:
                        k += 1
                    m = k
                    while m < len(both[1]) and both[1][m][1] < e:
                        own.append((i, both[1][m][0]))
                        m += 1
        links.append(own)
        docs.update(set(own))
    top = collections.Counter()
    for (i, _), n in docs.items():
        top[i] = max(top[i], n)
    out = []
    for both, own in zip(found, links):
        if not both:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        cuts = sorted({e for _, _, e in both[0]} & {e for _, _, e in both[1]})
        spelled, a, b = [], 0, 0
        for cut in cuts:
            group = [[], []]
            for k, at in ((0, a), (1, b)):
                while at < len(both[k]) and both[k][at][2] <= cut:
                    group[k].append(str(both[k][at][0]))
                    at += 1
                if k:
                    b = at
                else:
                    a = at
            spelled.append("|".join(",".join(g) for g in group))
        best = sum(docs[p] == top[p[0]] for p in own)
        out.append((len(both[0]), len(both[1]), len(cuts), len(own), best, sum(docs[p] for p in own), ";".join(spelled)))
    return out


ODD = [None, "", " ", "a", "\n\n  x\t", "▁ is a mark", "<s> </s> <|endoftext|> <0x0A>", "don't we'll I'd", "naïve café — “quotes” 梦 🙂", "\x00\x01", " x­", "x " * 3000, "zzzzqqqq" * 40, "   lead  and trail   ", "ﬁ Å İ", "same text", "same text", "1234567 89.5\r\n"]


def told(rows):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in rows)


@pytest.mark.parametrize("block_links", [1 << 20, 50])
def test_alignment_equals_brute_force(spark, block_links):
    rng = random.Random(4)
    words = "the of ing hyper token isation über straße año 42 3.14 -- ok() {x}".split()
    texts = ODD + [" ".join(rng.choice(words) + rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(40)]
    ids = [None if k == 3 else 7 if k in (15, 16) else 100 + k for k in range(len(texts))]
    frame = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").selectExpr("*", "1 as block", "'p' as pairs", "2 as Links")
    got = align_tokens(frame.repartition(3), A, B, block_links=block_links).collect()
    assert told(got) == sorted((str(i), *row) for i, row in zip(ids, brute(texts)))
    assert align_tokens(frame.limit(0), A, B).count() == 0


def test_pieces_cut_here_give_the_tokenizers_ids():
    rng = random.Random(2)
    letters = "abcXYZ  \n\t\r019.,'!?-_éßñÿ¿ɏǅ't's'll"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(400)] + [t for t in ODD if t]
    side, plain = ByteLevel(A), Tokenizer.from_file(A)
    plain.encode_special_tokens = True
    assert side.known
    assert list(side.encode(texts)) == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_alignment_of_the_test_table(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    want = {i: (*row[:6], hashlib.sha256(row[6].encode()).hexdigest() if row[6] else "") for (i, _), row in zip(rows, brute([t for _, t in rows]))}
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in QUERIES["op12_token_alignment"](spark, SF).collect()}
    assert got == want and np.mean([w[0] > 0 for w in want.values()]) > 0.9
