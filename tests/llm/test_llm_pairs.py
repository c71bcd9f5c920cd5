"""Near duplicates and substring dedup against brute force, on tables with every odd case."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from listflow.llm.common import Words, spread_rows, table, windows
from listflow.llm.components import components
from listflow.llm.near_dup import DISTANCE, SIZE, near_duplicates, one_of_each, shingle_sets, signature, similar
from listflow.llm.queries import QUERIES
from listflow.llm.repeats import remove_repeats

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall(text or "")


def shingles(text, n):
    w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def brute_components(rows, n, percent=80):
    """The shingles of each row, and the smallest id that its links reach; rows without an id link nothing."""
    sets = [shingles(text, n) for _, text in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = collections.defaultdict(list)
    for k, s in enumerate(sets):
        if rows[k][0] is not None:
            for x in s:
                keys[x].append(k)
    tried = set()
    for members in keys.values():
        for k, b in enumerate(members):
            for a in members[:k]:
                if (a, b) not in tried:
                    tried.add((a, b))
                    common = len(sets[a] & sets[b])
                    if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                        x, y = root(a), root(b)
                        up[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sets, [None if i is None else least[root(k)] for k, (i, _) in enumerate(rows)]


def told(rows, sets, component):
    return sorted(((i, len(s), c, i is None or c == i) for (i, _), s, c in zip(rows, sets, component)), key=str)


def near_family(rng, size, edits):
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    out = []
    for _ in range(size):
        copy = list(base)
        for _ in range(rng.randrange(edits)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def odd_rows():
    rng = random.Random(3)
    rows = [(1, None), (2, ""), (3, " \t\r\n"), (4, "one two"), (5, "ONE two"), (6, "one  two\n"), (7, "é"), (8, "É"), (None, "a b c d e f"), (None, None)]
    rows += [(9, "a b c d e f"), (10, "A B C D E F"), (10, "A B C D E F"), (11, "x " * 30000), (12, "x " * 30000 + "y")]
    texts = near_family(rng, 90, 10) + near_family(rng, 6, 3) + near_family(rng, 3, 30)
    return rows + [(100 + i, t) for i, t in enumerate(texts)]


def test_word_hashes_follow_the_words():
    texts = [b"a bb  a\tbb", "é bb\x0b".encode(), b"", b"   ", b"bb"]
    w = Words(texts)
    assert w.count.tolist() == [4, 2, 0, 0, 1]
    names = [w.data[a:b] for a, b in zip(w.start, w.end)]
    assert names == [x for t in texts for x in t.split()]
    assert {n: len({int(h) for m, h in zip(names, w.hash) if m == n}) for n in names} == {n: 1 for n in names}
    assert len(set(w.hash.tolist())) == len(set(names))
    h = np.array([5, 6, 5, 6, 5, 6, 7], np.uint64)
    assert len(set(windows(h, 2).tolist())) == 3 and windows(h, 2)[0] == windows(h, 2)[2] and len(windows(h, 8)) == 0


def test_signatures_within_the_distance_at_the_limit():
    rng = random.Random(1)
    worst = 0
    for text in near_family(rng, 2, 1)[:1] * 40:
        copy = text.split()
        for k in rng.sample(range(len(copy)), 2):
            copy[k] = f"q{rng.random()}"
        a, b = shingle_sets([text.encode(), " ".join(copy).encode()], 4)
        if similar(a, b, 80):
            apart = np.frombuffer(signature(a), "<u2") != np.frombuffer(signature(b), "<u2")
            worst = max(worst, int(apart.sum()))
    assert SIZE == 48 and 0 < worst <= DISTANCE


def test_components_of_chains_stars_and_nulls(spark):
    links = [(i, i + 1) for i in range(10, 40)] + [(100, 200 + i) for i in range(20)] + [(7, 7), (None, 3), (5, None), (11, 10)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 10 for i in range(10, 41)} | {100: 100} | {200 + i: 100 for i in range(20)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates_equal_brute_force(spark, n):
    rows = odd_rows()
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "'z' as Digest", "2 as node", "3 as h")
    got = near_duplicates(frame, words=n).collect()
    assert sorted(map(tuple, got), key=str) == told(rows, *brute_components(rows, n))
    assert near_duplicates(frame.limit(0)).count() == 0


def repeated_ids():
    """Ids that several texts share, each with a near copy under another id, and one id that a third of all rows bear."""
    rng = random.Random(12)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    rows = []
    for i in range(12):
        a, b = text(), text()
        near = lambda t: "x" + t[1:]
        rows += [(i, a), (i, b), (100 + i, near(b)), (90 - i, near(a)), (1000, text()), (1000, a if i % 2 else text())]
    return rows + [(1000, rows[4][1])] * 3


def test_rows_with_one_id_are_linked_by_their_own_texts(spark):
    rows = repeated_ids()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = told(rows, *brute_components(rows, 5))
    assert sorted(map(tuple, near_duplicates(frame).collect()), key=str) == want
    rows = [(1, "a b c d e f g"), (1, "h i j k l m n o p q r s t u v"), (3, "x i j k l m n o p q r s t u v")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (3, 1)]


@pytest.mark.parametrize("make", [odd_rows, repeated_ids])
def test_one_row_of_each_group_stays(spark, make):
    rows = make() + [(None, "same words in here again"), (None, "same words in here again")]
    sets, component = brute_components(rows, 5)
    frame = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, _told int").selectExpr("*", "map('k', 1) as number", "array(1) as _id")
    got = one_of_each(frame)
    assert got.columns == frame.columns
    kept = [r._told for r in got.collect()]
    assert len(kept) == len(set(kept))
    free = {k for k, (i, _) in enumerate(rows) if i is None or not sets[k]}
    assert free <= set(kept)
    groups = collections.defaultdict(list)
    root = brute_roots(rows, sets)
    for k in set(range(len(rows))) - free:
        groups[root[k]].append(k)
    for members in groups.values():
        stay = [k for k in members if k in kept]
        assert len(stay) == 1 and rows[stay[0]][0] == min(rows[k][0] for k in members)


def brute_roots(rows, sets):
    """A group for each row: numbers in place of ids tell groups with equal smallest ids apart."""
    numbered = [(None if i is None else k, t) for k, (i, t) in enumerate(rows)]
    return brute_components(numbered, 5)[1]


def under_far_pivots():
    """Two near texts, and before them a far one for each key that both have (shingles of one word)."""
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join([*words[:58], "x", "y"])]
    by_word = {w: np.frombuffer(signature(shingle_sets_of(w)), "<u2") for w in words}
    a, b = (np.frombuffer(signature(shingle_sets_of(t)), "<u2") for t in texts)
    assert 0 < (a != b).sum() <= DISTANCE
    rows = {}
    for chunk in range(0, SIZE, 4):
        for out in range(4):
            at = [chunk + i for i in range(4) if i != out]
            if (a[at] == b[at]).all():
                few = sorted({next(w for w in words[:58] if by_word[w][i] == a[i]) for i in at})
                far = np.frombuffer(signature(shingle_sets_of(" ".join(few))), "<u2")
                assert (far[at] == a[at]).all() and (far != a).sum() > DISTANCE < (far != b).sum()
                rows[" ".join(few)] = None
    return [(i, t) for i, t in enumerate([*rows, *texts], 1)]


def shingle_sets_of(text):
    return next(shingle_sets([text.encode()], 1))


@pytest.mark.parametrize("block", [1024, 2])
def test_near_texts_under_far_pivots_are_met(spark, monkeypatch, block):
    monkeypatch.setattr("listflow.llm.near_dup.KEY_BLOCK", block)
    # with classes numbered by their ids, the far texts are the pivots
    monkeypatch.setattr("listflow.llm.near_dup.numbered", lambda: F.col("least.id"))
    rows = under_far_pivots()
    want = told(rows, *brute_components(rows, 1))
    assert (rows[-1][0], rows[-2][0]) in {(i, c) for i, _, c, _ in want}
    for parts in (1, 4):
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert sorted(map(tuple, near_duplicates(frame, words=1).collect()), key=str) == want


def test_near_duplicates_of_the_test_table(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    got = QUERIES["op1_near_duplicates"](spark, SF).collect()
    assert sorted(map(tuple, got), key=str) == told(rows, *brute_components(rows, 4))


def brute_repeats(rows, window):
    seen = collections.Counter(tuple(w[i : i + window]) for _, t in rows for w in [words_of(t)] for i in range(len(w) - window + 1))
    out = []
    for i, t in rows:
        w = words_of(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("window", [35, 8, 1, 2])
def test_repeats_equal_brute_force(spark, window):
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passages = [text(n) for n in (34, 35, 36, 50, 120)]
    rows = [(i, f"{text(rng.randrange(40))}\n{rng.choice(passages)}  {text(rng.randrange(40))} {rng.choice(passages)}") for i in range(40)]
    rows += [(50, "a b " * 60), (51, "Ä ö\n" * 17 + "ü"), (52, None), (53, ""), (54, " \n\t"), (None, passages[0]), (55, "same row " * 9), (55, "same row " * 9), (56, text(9000))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "map('k', doc_id) as grp", "array(1) as Entries", "'x' as _group")
    got = remove_repeats(frame, window=window)
    assert got.columns == [*frame.columns, "repeats"]
    told = [(r.doc_id, r.repeats.n_words, r.repeats.n_removed, " ".join(words_of(r.text))) for r in got.collect()]
    assert sorted(told, key=str) == sorted(brute_repeats(rows, window), key=str)
    for r in got.collect():
        assert sum(s.end - s.start for s in r.repeats.spans) == r.repeats.n_removed
        assert (r.text is None) == (r.doc_id == 52)
    assert remove_repeats(frame.limit(0), window=window).count() == 0


def test_copies_of_a_row_spread_over_groups(spark):
    rows = [(1, "same row " * 20)] * 3000 + [(2, "w " * 40), (3, None), (3, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "map('k', doc_id) as kind")
    spread = spread_rows(frame, "h")
    assert sorted((r.doc_id, str(r.text), str(r.kind)) for r in spread.collect()) == sorted((i, str(t), str({"k": i})) for i, t in rows)
    held = collections.Counter(r.h % 64 for r in spread.where("doc_id = 1").collect())
    assert len({r.h for r in spread.collect()}) == len(rows) and len(held) == 64 and max(held.values()) < 100
    got = remove_repeats(frame).collect()
    assert sorted((r.doc_id, r.repeats.n_removed) for r in got) == [(1, 40)] * 3000 + [(2, 40), (3, 0), (3, 0)]


def test_text_without_repeats_is_unchanged(spark):
    rows = [(1, "a  b\n\nc\t"), (2, " d ")]
    assert sorted((r.doc_id, r.text) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == rows


def test_repeats_of_the_test_table(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    want = {i: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in brute_repeats(rows, 35)}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op8_substring_dedup"](spark, SF).collect()}
    assert got == want
