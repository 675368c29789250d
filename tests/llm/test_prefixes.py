"""Prefix trie, benchmark decontamination, cross-tokenizer alignment, against plain versions."""

import collections
import hashlib
import random
import re
import zlib

import helpers as H
import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from orderlake.llm import alignment, trie, winnowing
from orderlake.llm.common import table
from orderlake.llm.pieces import model_path

CONV = "conv_id long, turn long, role string, text string"
BENCH = "item_id long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def conversations(rows):
    """conv_id -> its turns rebuilt."""
    own = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t, key=lambda x: x[:2] if x[0] else (False, 0))] for c, t in own.items()}
    out = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + t[h:]
    return out


def trie_of(built):
    """All nodes by their paths."""
    members = collections.defaultdict(list)
    for c, t in sorted(built.items()):
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, spared = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            spared[p[:d]] += (len(m) - 1) * (len(H.WORD.findall(p[-1][1])) if p else 0)
    return sorted((m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], spared[p], sha(",".join(str(c) for c in m if len(built[c]) == len(p)))) for p, m in members.items())


def found(spark, rows):
    df = trie.nodes(*trie.heads_shared(trie.ranked(spark.createDataFrame(rows, CONV).withColumns({"depth": F.lit("mine"), "x": F.lit("mine"), "b": F.lit(1)}))))
    return sorted(tuple(r)[:8] for r in df.collect())


def test_trie_equals_plain_version(spark):
    random.seed(3)
    rows = []
    for c in [*range(0, 70), 100, 103, 107]:
        if c in (20, 41, 44):
            continue
        for t in range(random.choice([1, 2, 3, 9, 17, 30])):
            rows.append((c, t, random.choice(["user", "assistant"]) if t % 3 else "user", random.choice(["a b", "c", "", " d  e f "]) if t < 14 else "same"))
    rows += [(30, None, None, None), (None, 1, "user", "x"), (500, 7, "user", ""), (501, 1000, "user", "late"), (501, -5, "user", "early")]
    assert found(spark, rows) == trie_of(conversations(rows))


def test_trie_of_very_long_conversations(spark):
    """Over several segments of blocks: two that part late, and one that ends in between."""
    rows = [(c, t, "user", f"turn {t}" if t < 1100 or c == 0 else f"other {t}") for c in (0, 1) for t in range(1300)] + [(2, t, "user", f"turn {t}") for t in range(900)]
    got = found(spark, rows)
    own = {c: [("user", x[3]) for x in rows if x[0] == c] for c in (0, 1, 2)}
    members = collections.defaultdict(list)
    key = {c: ["" for _ in t] for c, t in own.items()}
    for c, t in own.items():
        h = hashlib.sha256()
        for d, x in enumerate(t):
            h.update(repr(x).encode())
            key[c][d] = h.hexdigest()
        for d in range(len(t) + 1):
            members[d, key[c][d - 1] if d else ""].append(c)
    assert sorted((x[0], x[1], x[3]) for x in got) == sorted((min(m), d, len(m)) for (d, _), m in members.items())
    root = next(x for x in got if x[1] == 0)
    assert root[4:7] == (1, 2, sum((len(m) - 1) * 2 for (d, _), m in members.items() if d))


def test_trie_of_copies_and_of_nothing(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(1200) for t in range(5)] + [(5, 4, "user", "turn 4")]
    got = found(spark, rows)
    assert got == trie_of(conversations(rows)) and len(got) == 7
    assert found(spark, []) == []


def test_trie_ignores_the_order_of_rows_with_equal_turns(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (2, 0, "user", "a"), (2, 0, "user", "b"), (3, 0, "user", "a"), (3, 0, "user", "a")]
    turns = trie.ranked(spark.createDataFrame(rows, CONV))
    by = {r["depth"]: r["n_convs"] for r in trie.nodes(turns, turns.select("conv_id").distinct()).where("conv_id = 1").collect()}
    assert by[2] == 2


def leaked(texts, items):
    """index of the text -> n_words, n_hit, n_items, items_sha256: every window of every item is looked for."""
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(H.LOWER)) if w]
    bench = [("" if i is None else str(i), split(t)) for i, t in items]
    out = []
    for t in texts:
        w, hit, own = split(t), set(), set()
        for item, b in bench:
            n = min(len(b), 10)
            for window in {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if n else ():
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) == window:
                        hit.update(range(k, k + n))
                        own.add(item)
        out.append((len(w), len(hit), len(own), sha(",".join(sorted(own)))))
    return out


def contaminated(spark, texts, items):
    df = winnowing.contamination(H.clashing(H.docs(spark, texts)), spark.createDataFrame(items, BENCH).withColumn("f", F.lit("mine")))
    return [(r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in sorted(df.collect(), key=lambda r: r["doc_id"])]


@pytest.mark.parametrize("words", [3, 12, 200])
def test_every_shared_window_is_found(spark, words):
    random.seed(words)
    say = lambda n: " ".join(f"w{random.randrange(words)}" for _ in range(n))
    items = [(i, say(random.randrange(1, 30))) for i in range(25)] + [(7, "W1, w2!"), (None, say(14)), (90, None), (91, "... "), (92, say(12)), (92, say(11))]
    texts = [None, "", " . ", *[say(random.randrange(1, 120)) for _ in range(40)]]
    texts += [f"{say(9)} {random.choice(items[:25])[1].upper().replace(' ', ', ')}. {say(15)}" for _ in range(40)] + ["É é ñandú"] + [items[3][1]] * 3
    assert contaminated(spark, texts, items) == leaked(texts, items)


def test_long_text_empty_benchmark_and_rows_without_id(spark):
    item = " ".join(f"needle{i}" for i in range(10))
    assert contaminated(spark, [f"{H.LONG} {item} {H.LONG}"], [(1, item)]) == [(80_010, 10, 1, sha("1"))]
    assert contaminated(spark, ["a b"], []) == [(2, 0, 0, sha(""))]
    assert contaminated(spark, [], [(1, item)]) == []
    df = winnowing.contamination(H.docs(spark, [(None, item), (None, item), (4, "x")]), spark.createDataFrame([(1, item)], BENCH))
    assert sorted((r["doc_id"] is None, r["n_hit"], r["contaminated"]) for r in df.collect()) == [(False, 0, False), (True, 10, True), (True, 10, True)]


def aligned(rows):
    """The contract's columns by row index, from whole texts and single tokens."""
    al = alignment.aligner(model_path(alignment.A_MODEL), model_path(alignment.B_MODEL))
    each, pairs = [], collections.Counter()
    for t in rows:
        a, b, raw = al.a.encode(" " + (t or ""), add_special_tokens=False).ids, al.b.encode(t or ""), (" " + (t or "")).encode()
        if not t or b"".join(al.a_bytes[i] for i in a) != raw or b"".join(al.b_bytes[i] for i in b) != raw:
            each.append(None)
            continue
        ends = [dict(zip(np.cumsum([len(size[i]) for i in ids]).tolist(), ids, strict=True)) for ids, size in ((a, al.a_bytes), (b, al.b_bytes))]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        sides = []
        for e in ends:
            at, found = iter(e.items()), []
            for c in cuts:
                own = []
                while not own or own[-1][0] < c:
                    own.append(next(at))
                found.append(",".join(str(i) for _, i in own))
            sides.append(found)
        groups = ";".join(f"{a}|{b}" for a, b in zip(*sides, strict=True))
        links = [(ends[1][c], ends[0][c]) for c in cuts]
        pairs.update(links)
        each.append((len(a), len(b), groups, links))
    best = collections.defaultdict(int)
    for (b, _), n in pairs.items():
        best[b] = max(best[b], n)
    return [(0, 0, 0, 0, 0, 0, "") if x is None else (x[0], x[1], len(x[3]), len(x[3]), sum(pairs[k] == best[k[0]] for k in x[3]), sum(pairs[k] for k in x[3]), sha(x[2])) for x in each]


def alignment_rows(spark, texts, parts=3, limits=alignment.Limits()):
    df = alignment.alignment(H.clashing(H.docs(spark, texts)).repartition(parts), model_path(alignment.A_MODEL), model_path(alignment.B_MODEL), limits=limits)
    return [tuple(r[c] for c in alignment.MEASURES) for r in sorted(df.collect(), key=lambda r: r["doc_id"])]


ODD = [None, "", " ", "\n\n x\ny", "  a  b ", "a\tb\x00c", "日本語 テキスト", "\U0001f600x\U0001f600", "<s> </s> <0x41> <|endoftext|>", "x" * 3000, " " * 77, "▁a ▁", "é" * 50 + " 12345", "a\r\nb\x85c\xa0d", "it's ΟΔΟΣ İI", "a   b\n\n\nc d's 's", "ok then 'll go\n'll", "same text", "same text", H.LONG]


def test_alignment_equals_plain_version(spark):
    texts = ODD + [r["text"] for r in table(spark, oracle.DATA, "documents").limit(120).collect()]
    assert alignment_rows(spark, texts) == aligned(texts)


def test_alignment_in_small_chunks_splits_and_parts(spark):
    random.seed(9)
    texts = ODD[:-1] + [" ".join(random.choice(["the", "of", "it's", "x\ny", "naïve", "über", "12"]) for _ in range(random.randrange(300))) for _ in range(60)]
    small = alignment.Limits(links=300, documents=7, split=100, row=5, part=50)
    assert sum(len(alignment.parts(t, small.part)) for t in texts if t) > len(texts) + 50
    assert alignment_rows(spark, texts, 5, small) == aligned(texts)


def test_alignment_of_nothing(spark):
    assert alignment_rows(spark, []) == []
    df = alignment.alignment(H.docs(spark, [(None, "a b"), (None, "a b")]), model_path(alignment.A_MODEL), model_path(alignment.B_MODEL))
    assert [(r["doc_id"], r["n_links"], r["n_best"], r["count_sum"]) for r in df.collect()] == [(None, 2, 2, 4)] * 2


def test_runs_are_split_and_counted_by_pairs():
    rng = np.random.default_rng(1)
    links, docs = rng.integers(0, 50, 5000) * 1000 + rng.integers(0, 3, 5000), rng.integers(0, 20, 5000)
    want, got = collections.Counter(zip(links.tolist(), docs.tolist())), collections.Counter()
    for radix, n, heads, body in alignment.runs(links.astype("<u4"), docs, 1000):
        pair, total, many = alignment.unpacked(heads, *alignment.HEADS)
        doc, count = alignment.unpacked(body, *alignment.BODY)
        assert n == len(doc) == many.sum() and 0 <= radix < alignment.RADIXES and (np.diff(pair.astype(np.int64)) > 0).all() and total.sum() == count.sum()
        got.update(dict(zip(zip(np.repeat(pair, many).tolist(), doc.tolist()), count.tolist())))
    assert got == want
