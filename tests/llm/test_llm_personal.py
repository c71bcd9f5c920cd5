"""Personal data: patterns against plain ones, messages against enumeration, and what the field adds."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from listflow.llm import personal
from listflow.llm.common import table
from listflow.llm.personal import FORBIDDEN, KIND_OF, KINDS, LABELS, NEVER, Field, Graph, Words, find_personal, fit_field, matches
from listflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
PLAIN = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_base(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == 2:
                doubled = [int(d) * 2 if i % 2 else int(d) for i, d in enumerate(reversed(digits))]
                if not 14 <= len(digits) <= 19 or sum(d // 10 + d % 10 for d in doubled) % 10:
                    continue
            if kind == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def card(rng):
    body = [4, *(rng.randrange(10) for _ in range(14))]
    total = sum((2 * d) // 10 + (2 * d) % 10 if i % 2 == 0 else d for i, d in enumerate(reversed(body)))
    return "".join(map(str, body)) + str(-total % 10)


def test_patterns_equal_plain_ones():
    rng = random.Random(7)
    parts = ["a@b.c", "x.y@z", "@", ".", "..", "1.2.3.4", "300.1.1.1", "+1", "+", "(743)", "555-3824", " ", " ", "  ", "-", "4", "12", "é", "\n", "a", "_%", "@b-c.d.e", "1.2.3.4.5.6.7.8", "٣", "0255.00.1.02"]
    for k in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        if k % 3 == 0:
            text += card(rng) + rng.choice(["", " ", "-", "x"]) + rng.choice(["", card(rng), "1"])
        assert matches(text)[0] == plain_base(text), text


def test_patterns_take_time_in_proportion():
    for text in ("1" * 400_000, "a" * 400_000, "a" * 400_000 + "@", "1.1" * 200_000, "+1" * 200_000, "@" * 400_000, "a@" * 200_000, "1 " * 200_000):
        matches(text)
        words = Words()
        words.add(text[:4000] if text == "1 " * 200_000 else text)


def small_graph(rng, n, edges, skips):
    words = Words([0] * n, [0] * n, list(range(n)), [[0, 1 + i] for i in range(n)], [(a, b, k) for a, b, k in skips])
    for a, b in edges:
        words.run[b] = words.run[a]
    graph = Graph(words)
    model = Field(rng.normal(size=(personal.FEATURES, len(LABELS))), rng.normal(size=(len(LABELS),) * 2), np.array([0.9, 0.4]))
    return graph, model


def exact_marginals(graph, model):
    unary, pair, n = graph.scores(model), graph.pairs(model), len(graph.opens)
    out = np.zeros((n, len(LABELS)))
    for y in itertools.product(range(len(LABELS)), repeat=n):
        score = sum(unary[i, y[i]] for i in range(n)) + sum(pair[k, y[a], y[b]] for k, a, b in zip(graph.kind, graph.a, graph.b))
        out[range(n), y] += np.exp(score)
    return out / out.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("edges", [16_384, 2])
def test_messages_are_exact_on_trees_and_close_on_loops(monkeypatch, edges):
    monkeypatch.setattr(personal, "EDGES", edges)
    rng = np.random.default_rng(1)
    for skips, bound in (([(1, 3, 0)], 1e-3), ([(0, 2, 0), (1, 3, 1)], 0.15)):
        graph, model = small_graph(rng, 4, [(0, 1), (2, 3)], skips)
        found = personal._normal(graph.pass_messages(graph.scores(model), graph.pairs(model), 200, 1e-9))
        assert np.abs(found - exact_marginals(graph, model)).max() < bound
        assert (found[graph.opens][:, [4, 6]] < 1e-6).all()


def test_skip_edges_make_alike_words_agree():
    words = Words()
    words.add("call 555-3824 or +1 (743) 555-3824 now 555-3824")
    assert [(a, b) for a, b, _ in words.skips] == [(0, 3), (3, 4)]
    graph = Graph(words)
    weights = np.zeros((personal.FEATURES, len(LABELS)))
    steps = np.full((len(LABELS),) * 2, -1.0)
    unary = np.zeros((5, len(LABELS)))
    unary[:, 0] = 0.5
    unary[0, 0], unary[1, 5], unary[2, 6], unary[3, 6] = 1.0, 6.0, 6.0, 6.0
    told = []
    for reward in (0.0, 3.0):
        graph.into_a[:], graph.into_b[:] = 0, 0
        pair = graph.pairs(Field(weights, steps, np.array([reward, reward])))
        told.append(KIND_OF[graph.pass_messages(unary, pair, 100).argmax(axis=1)].tolist())
    assert told == [[-1, 3, 3, 3, -1], [3, 3, 3, 3, 3]]
    assert FORBIDDEN[0, 4] == NEVER and FORBIDDEN[3, 4] == 0


def made_documents(n, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice("the on ea thing de la und 7.9. 12 1999 x=3 no.5".split()) for _ in range(30)]
        phone, number = f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}", card(rng)
        for thing in (phone, number, f"{rng.choice('abc')}x.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com", ".".join(str(rng.randrange(256)) for _ in range(4)), f'token = "{rng.getrandbits(120):x}"'):
            if rng.random() < 0.5:
                words[rng.randrange(30)] = thing
        rows.append((i, " ".join(words)))
    return rows


def test_field_adds_what_the_patterns_miss(spark):
    rows = made_documents(400)
    rng = random.Random(1)
    one, two, number, last = card(rng), card(rng), "+1 (523) 555-1055", "555-1055"
    odd = [(1000, f"so {one} {two} it"), (1001, f"dial {number} today, or {last} later"), (1002, "in 1999 only 12 of 7.9. and no.5"), (1003, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"')]
    frame = spark.createDataFrame(rows + odd, "doc_id long, text string")
    model = fit_field(frame)
    got = {r.doc_id: r for r in find_personal(frame, model).collect()}
    of = lambda i: [(dict(rows + odd)[i][s.start : s.end], s.kind) for s in got[i].spans]
    assert of(1000) == [(one, "card"), (two, "card")] and got[1000].base == []
    assert of(1001) == [(number, "phone"), (last, "phone")]
    assert of(1002) == of(1003) == []
    # on fresh texts it adds planted items that the patterns read together with a number beside them, and little else
    fresh = dict(made_documents(200, seed=9))
    planted = re.compile(r"\+1 \([0-9]{3}\) 555-[0-9]{4}|[0-9]{16}|[a-z]+\.[0-9]+@mail[0-9]\.example\.com|[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
    right = wrong = 0
    for r in find_personal(spark.createDataFrame(list(fresh.items()), "doc_id long, text string"), model).collect():
        for s in r.spans:
            if s not in r.base:
                ok = planted.fullmatch(fresh[r.doc_id][s.start : s.end])
                right, wrong = right + bool(ok), wrong + (not ok)
    assert right >= 30 and 3 * wrong <= right


def test_labels_of_held_out_words_follow_the_patterns():
    words, labels = Words(), []
    for _, text in made_documents(300):
        first = len(words.start)
        words.add(text)
        labels += words.labels(first, matches(text)[0])
    model = personal.fit(words, np.array(labels))
    fresh, want = Words(), []
    for _, text in made_documents(200, seed=8):
        first = len(fresh.start)
        fresh.add(text)
        want += fresh.labels(first, matches(text)[0])
    graph = Graph(fresh)
    found = graph.pass_messages(graph.scores(model), graph.pairs(model), 100).argmax(axis=1)
    # a number beside a card is the card's by the patterns where the check digit happens to fit
    assert (KIND_OF[found] == KIND_OF[want]).mean() >= 0.97


@pytest.mark.parametrize("fitted", [False, True])
def test_odd_rows(spark, fitted):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a@b.cd"), (4, "a@b.cd"), (4, "a@b.cd"), (5, "é 🙂 a@b.cd\n1.2.3.4 +12345678901"), (6, "5 " * 3000), (7, "x" * 100_000 + " a@b.cd"), (8, "9" * 100_000), (9, "٣٤@x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as base", "'z' as Spans", "2 as words")
    found = find_personal(frame, fit_field(frame) if fitted else personal.no_field())
    got = found.collect()
    assert sorted((str(r.doc_id), [(s.start, KINDS.index(s.kind), s.end) for s in r.base]) for r in got) == sorted((str(i), [] if i == 8 else plain_base(t)) for i, t in rows)
    for r in got:
        assert [s for s in r.spans if s in r.base] == r.base
        assert all(a.end <= b.start or a in r.base and b in r.base for a, b in zip(r.spans, r.spans[1:]))
    assert find_personal(frame.limit(0), fit_field(frame.limit(0))).count() == 0
    told = {r.doc_id: r for r in personal.digests(found).collect()}
    assert (told[5].n_email, told[5].n_ip, told[5].n_card, told[5].n_phone, told[1].spans) == (1, 1, 0, 1, "")


def test_personal_data_of_the_test_table(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    got = {r.doc_id: r for r in QUERIES["op13_personal_data"](spark, SF).collect()}
    added = 0
    for i, text in rows:
        base = plain_base(text)
        listed = [f"{KINDS[k]}:{a}:{b}" for a, k, b in base]
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for _, k, _ in base) for kind in range(4))
        spans = r.spans.split(",") if r.spans else []
        assert set(listed) <= set(spans)
        for s in set(spans) - set(listed):
            kind, a, b = s.split(":")
            added += 1
            # here only cards that stand side by side are missed by the patterns
            assert kind == "card" and re.fullmatch(r"[0-9]{16}", text[int(a) : int(b)]), text[int(a) : int(b)]
    assert added >= 2
