"""N-gram Jaccard join and suffix-array dedup against brute force."""

import random

import helpers as H
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from orderlake.llm import graph, jaccard, repeats, suffixes


def near(rng, base, edits):
    w = base.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, texts = text(40), [None, "", " ", "one", "One", "one two", "one two three four", H.LONG, H.LONG + " end"]
    for _ in range(40):
        base = text(rng.randrange(4, 120))
        texts.append(base)
        texts += [near(rng, base, rng.randrange(0, 4)) for _ in range(rng.randrange(0, 5))]
        texts.append(passage + " " + text(rng.randrange(60)))
    hot = text(90)
    texts += [hot.upper()] * 20 + [near(rng, hot, rng.randrange(0, 6)) for _ in range(60)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,size,num", [(1, 4, 85), (2, 5, 80)])
def test_classes(spark, seed, size, num):
    texts = corpus(seed)
    got = H.collected(jaccard.classes(H.clashing(H.docs(spark, texts)).repartition(5), size, num, 100), "doc_id", "n_shingles", "component_id")
    assert got == H.classes(list(enumerate(texts)), size, num, 100)


def test_chain_across_a_group(spark):
    """A chain of links whose ends don't link, and sets of equal size that share half."""
    w = [f"c{i}" for i in range(400)]
    texts = [" ".join(w[k * 6 : k * 6 + 100]) for k in range(8)] + [" ".join(w[:50] + [f"x{j}_{i}" for i in range(50)]) for j in range(30)]
    got = H.collected(jaccard.classes(H.docs(spark, texts), 4, 85, 100), "doc_id", "n_shingles", "component_id")
    assert got == H.classes(list(enumerate(texts)), 4, 85, 100) and got[7][1] == 0


def test_forests_in_blocks(monkeypatch):
    """A tile of near sets gives a pair while one is open, fewer than it has sets for a forest, however it is cut in blocks."""


    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 200).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: 200 - k % 9], rng.integers(0, 2**63, k % 9).astype(np.uint64)])) for k in range(40)]
    members = sorted([[k, len(s), k, jaccard.bitmap(s), None, 0, len(s)] for k, s in enumerate(sets)], key=lambda m: (m[1], m[2]))
    got = {}
    for most in (10, 10**6):
        monkeypatch.setattr(jaccard, "PAIRS_IN_MEMORY", most)
        got[most] = [r for b in jaccard.spanning(members, 85, 100, 1, run=7) for r in b.to_pylist()]
        assert got[most].pop() == {"a": 7, "b": None}  # more pairs are open
    assert len(got[10]) == len(got[10**6]) == 39
    for m in members:
        m[4] = list(range(40))
    assert not list(jaccard.spanning(members, 85, 100, 8))


def test_runs_in_cells(spark, monkeypatch):
    """A run of more sets than a cell: no tile has more than two cells, and no link is lost."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    texts = [" ".join(base[: 60 + rng.randrange(60)] + [f"y{k}_{j}" for j in range(rng.randrange(30))]) for k in range(120)] + corpus(3)[:60]
    want = H.classes(list(enumerate(texts)), 4, 85, 100)
    monkeypatch.setattr(jaccard, "CELL", 15)
    monkeypatch.setattr(jaccard, "LISTED", 2)
    assert H.collected(jaccard.classes(H.docs(spark, texts), 4, 85, 100), "doc_id", "n_shingles", "component_id") == want
    sizes = {i: rng.randrange(50, 400) for i in range(600)}
    comp = {i: 0 if i < 300 else i for i in sizes}
    still = spark.createDataFrame([(1, i, comp[i], n, n, 600) for i, n in sizes.items()] + [(2, 1, 1, 50, 50, 2), (2, 2, 2, 50, 50, 2)], "run long, id long, comp long, n long, left long, total long")
    tiles = {}
    for r in jaccard.placed(still, 85, 100).collect():
        tiles.setdefault((r["run"], r["p"], r["q"]), set()).add(r["id"])
    assert not any(r["p"] == r["q"] and r["comp"] == 0 for r in jaccard.placed(still.where("run = 1"), 85, 100).collect())
    assert max(len(t) for t in tiles.values()) < 90 and {1, 2} in tiles.values()
    together = {(a, b) for t in tiles.values() for a in t for b in t}
    assert all((a, b) in together for a in sizes for b in sizes if comp[a] != comp[b] and 85 * max(sizes[a], sizes[b]) <= 100 * min(sizes[a], sizes[b]))


def test_shingle_in_parts(spark, monkeypatch):
    """A frequent shingle's entries in several tasks, and runs that are sent in pieces, give the same links."""
    rng = random.Random(5)
    texts = corpus(5) + [" ".join([f"h{i}" for i in range(30)] + [f"z{k}_{j}" for j in range(rng.randrange(0, 3))]) for k in range(150)]
    for name, value in (("SPLIT", 20), ("LONG_RUN", 7), ("CLOSE_LOOK", 3), ("FIRSTS", 1)):
        monkeypatch.setattr(jaccard, name, value)
    assert H.collected(jaccard.classes(H.docs(spark, texts).repartition(3), 4, 85, 100), "doc_id", "n_shingles", "component_id") == H.classes(list(enumerate(texts)), 4, 85, 100)


def test_classes_odd_rows(spark):
    assert jaccard.classes(H.docs(spark, [])).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b C d e f")]
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard.classes(H.docs(spark, rows)).collect()), key=repr)
    assert got == sorted([(1, 1), (1, 1), (None, None), (2, 1)], key=repr)
    left = jaccard.drop(H.clashing(H.docs(spark, rows)))
    assert sorted((r["doc_id"] for r in left.collect()), key=repr) == [1, 1, None]


def test_bound_is_never_below(spark):


    rng = np.random.default_rng(4)
    for _ in range(300):
        pool = rng.integers(0, 2**63, 400).astype(np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 300))) for _ in range(2))
        assert jaccard.bound(jaccard.bitmap(a), jaccard.bitmap(b), len(a), len(b)) >= len(np.intersect1d(a, b))


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)] + [(5, 5)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@given(st.lists(st.integers(1, 4), max_size=60))
@settings(max_examples=400, deadline=None)
def test_suffix_array(x):
    x = [*x, 0]
    assert suffixes.suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


def texts_with_repeats(seed):
    rng = random.Random(seed)
    letters = "abcdefghijklmnop é\n"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [text(rng.randrange(150, 700)) for _ in range(12)]
    out = [None, "", "short", "z" * 700, "ab" * 400, text(199), text(5000)]
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            s = rng.choice(shared)
            a = rng.randrange(len(s))
            parts += [text(rng.randrange(0, 300)), s[a : a + rng.randrange(100, 500)]]
        out.append("".join(parts))
    out += [out[10]] * 5 + [out[11][:250] + "Q" + out[11][250:]] + [text(100) + shared[0] for _ in range(40)]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats(spark, seed):
    texts = texts_with_repeats(seed)
    got = H.collected(repeats.removed(H.clashing(H.docs(spark, texts)).repartition(4)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == H.repeats(list(enumerate(texts)))


def test_repeats_odd_rows(spark):
    assert repeats.removed(H.docs(spark, [])).count() == 0
    t = "".join(chr(97 + (i * i) % 26) for i in range(300)) + "tail"
    got = sorted(((r["doc_id"], r["n_removed"]) for r in repeats.removed(H.docs(spark, [(1, t), (1, t), (None, t), (2, "x" + H.LONG)])).collect()), key=repr)
    assert [x for x in got if x[0] == 1] == [(1, len(t)), (1, len(t))] and (None, len(t)) in got and (2, 0) in got


def test_repeats_of_rows_that_share_an_id_or_have_none(spark):
    rng = random.Random(9)
    a, b, c = ("".join(rng.choice("abcdefgh ") for _ in range(600)) for _ in range(3))
    rows = [(1, a), (1, b), (2, a[100:500]), (None, c), (None, b[:150] + c[50:300])]
    got = {(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in repeats.removed(H.docs(spark, rows)).collect()}
    assert got == {(1, 600, 400), (1, 600, 0), (2, 400, 400), (None, 600, 250), (None, 400, 250)}


def test_anchors_in_blocks(monkeypatch):
    from orderlake.llm import anchors

    rng = random.Random(3)
    texts = ["".join(rng.choice("ab ") for _ in range(rng.randrange(0, 2000))).encode() for _ in range(30)]
    whole = anchors.anchors(texts)
    monkeypatch.setattr(anchors, "BLOCK", 333)
    assert all((x == y).all() for x, y in zip(whole, anchors.anchors(texts), strict=True))


def test_split_of_contexts(spark, monkeypatch):
    """Suffix arrays of few contexts each find the same."""
    monkeypatch.setattr(repeats, "AT_ONCE", 3)
    texts = texts_with_repeats(3)
    got = H.collected(repeats.removed(H.docs(spark, texts)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == H.repeats(list(enumerate(texts)))


def test_bytes_decide_between_neighbours():
    rng = np.random.default_rng(2)
    rows = rng.integers(97, 100, (120, repeats.SPAN)).astype(np.uint8)
    for i in range(1, 120, 2):
        rows[i] = rows[i - 1]
        rows[i, rng.integers(0, repeats.SPAN)] = 50
    a, starts = np.repeat(np.arange(119), 169), np.tile(np.arange(169), 119)
    want = [(rows[x, s : s + 200] == rows[x + 1, s : s + 200]).all() for x, s in zip(a, starts)]
    assert any(want) and repeats.common(rows, a, a + 1, starts, 50).tolist() == want
    assert not len(repeats.common(rows, a[:0], a[:0], starts[:0]))


@pytest.mark.parametrize("many", [0, 5, 10**6])
def test_anchors_with_many_contexts_are_dealt_by_windows(spark, many):
    """A passage with other neighbours in every text: its edges' anchors have a context for each of them."""
    rng = random.Random(11)
    word = lambda n: " ".join(f"{rng.randrange(10**9):x}" for _ in range(n))
    passage, other = word(60), word(30)
    texts = [f"{word(40)} {passage} {word(40)}" for _ in range(25)] + [f"{word(10)} {passage[:300]} {word(30)} {other}" for _ in range(8)] + [other, passage[:199], passage[:200], word(50), None, f"{other} é {passage}"]
    rows = list(enumerate(texts))
    got = repeats.removed(H.clashing(H.docs(spark, texts)).repartition(5), many=many)
    assert H.collected(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == H.repeats(rows)
