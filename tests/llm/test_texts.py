"""Language ID, SentencePiece, HTML extraction, token output, and the pipeline."""

import collections
import hashlib
import re
import zlib

import helpers as H
import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from orderlake.llm import dom, language, pieces, tokens, wrappers
from orderlake.llm.common import table
from orderlake.sources.paths import fresh

ODD = [None, "", " ", "\n\n x\ny", "  a  b ", "a\tb\x00c", "日本語 テキスト", "\U0001f600x\U0001f600", "<s> </s> <0x41> <|endoftext|>", "x" * 3000, " " * 77, "▁a ▁", "é" * 50 + " 12345", "a\r\nb\x85c\xa0d", "it's ΟΔΟΣ İI", "\x01 a\x01b \x01", "Abc. abc ABC!? Abc.'s it'S. a.b. ... .,; É. É", H.LONG]


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_pieces_equal_the_library(spark):
    import sentencepiece

    d = H.docs(spark, ODD).unionByName(table(spark, oracle.DATA, "documents").withColumn("doc_id", F.col("doc_id") + 1000).limit(150))
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    want = {}
    for r in d.collect():
        ids = [1, *sp.encode(r["text"] or ""), 2]
        want[r["doc_id"]] = (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(sp.decode(ids).encode()), 0)
    assert H.collected(pieces.digests(H.clashing(d), pieces.model_path()), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_corrected") == want
    back = pieces.decode(pieces.encode(d, pieces.model_path()), pieces.model_path())
    assert {r["doc_id"]: sha(r["decoded"].encode()) for r in back.collect()} == {k: v[2] for k, v in want.items()}
    assert pieces.digests(H.docs(spark, []), pieces.model_path()).count() == 0


def test_agenda_alone_equals_the_library():
    p = pieces.pieces(pieces.model_path())
    written = lambda s: s if s[:1] in (pieces.SPACE, "\n") else pieces.SPACE + s  # noqa: E731  a word's symbols, as its agenda takes them
    for t in ODD:
        assert [x for s in p.segments(t or "") for x in p.agenda(written(s))] == p.sp.encode(t or "")
    assert p.agenda("") == []


def test_token_files(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokens.model_path(tokens.MODEL))
    d = H.docs(spark, ODD).unionByName(table(spark, oracle.DATA, "documents").withColumn("doc_id", F.col("doc_id") + 1000).limit(150))
    want, start = {}, 0
    for r in sorted(d.collect(), key=lambda r: r["doc_id"]):
        ids = [*tk.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want[r["doc_id"]] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    path = fresh(spark, "tokens")
    tokens.write(H.clashing(d).repartition(5), path, tokens.model_path(tokens.MODEL))
    assert H.collected(tokens.digests(spark, path), "doc_id", "start", "n_tokens", "ids_crc32") == want
    tokens.write(H.docs(spark, []), path := fresh(spark, "tokens"), tokens.model_path(tokens.MODEL))
    assert tokens.digests(spark, path).count() == 0
    tokens.write(H.docs(spark, [(5, "a"), (None, "a b"), (-3, "a"), (None, None)]), path := fresh(spark, "tokens"), tokens.model_path(tokens.MODEL))
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in tokens.digests(spark, path).collect())
    n = len(tk.encode("a", add_special_tokens=False).ids) + 1
    assert {x[1] for x in got[:2]} == {None} and [x[1:] for x in got[2:]] == [(-3, n), (5, n)]


@pytest.mark.parametrize("high", [200, 70_000, 2**32 - 1])
def test_codes_read_anywhere(high):
    rng = np.random.default_rng(high)
    ids = rng.integers(0, high + 1, 20_000).astype("<u4")
    ids[::3] = 5
    levels = [tokens.of_row(tokens.to_row(x)) for x in tokens.pack(ids)]
    for a, b in [(0, 20_000), (5, 6), (513, 515), (511, 512), (19_999, 20_000), (3, 3), *rng.integers(0, 20_000, (50, 2)).tolist()]:
        assert (tokens.read(levels, a, b) == ids[a:b]).all()


def brute_grams(text):
    fold = language.folded()
    out = collections.Counter()
    for w in "".join(chr(fold[ord(c)]) if fold[ord(c)] else " " for c in text).split(" "):
        for n in (1, 2, 3):
            for i in range(len(w) + 3 - n if w else 0):
                g = f"\0{w}\0"[i : i + n]
                if g != "\0":
                    k = n
                    for c in g:
                        k = k << language.BITS | ord(c)
                    out[k] += 1
    return out


def test_grams():
    texts = ["", "Hello, wörld a", "...", "ÀB cd\nab", "x", "日本 語", " ", "a "] * 2
    owner, gram, n, lettered = language.counted(texts)
    for i, t in enumerate(texts):
        want = brute_grams(t)
        assert dict(zip(gram[owner == i].tolist(), n[owner == i].tolist(), strict=True)) == want and lettered[i] == bool(want)


def brute_distance(text, profile, top):
    c = brute_grams(text)
    order = sorted(c, key=lambda g: (-c[g], g))[:top]
    rank = {g: i for i, g in enumerate(profile)}
    return sum(abs(rank[g] - i) if g in rank else top for i, g in enumerate(order)) / (len(order) * top)


def test_language_accuracy_and_distance(spark):
    rows = language.op2_language_id(spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "documents"), "doc_id")
    got = [r for r in rows.collect() if r["lang"] is not None and r["lang_pred"] != "und"]
    held = [r for r in got if r["held_out"]]
    assert len(held) > 200 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    train = table(spark, "/root/testdata/sf0.01", "documents").where(~language.held_out())
    profiles = language.learn(train)
    sums = {}
    for r in train.where("lang IS NOT NULL").collect():
        sums.setdefault(r["lang"], collections.Counter()).update(brute_grams(r["text"] or ""))
    for lang, c in sums.items():
        assert profiles[lang] == sorted(c, key=lambda g: (-c[g], g))[: language.TOP]
    for r in got[:40]:
        best = min(sorted(profiles), key=lambda x: brute_distance(r["text"], profiles[x], language.TOP))
        assert r["lang_pred"] == best and abs(r["score"] - 1 + brute_distance(r["text"], profiles[best], language.TOP)) < 1e-9


def test_language_odd_rows(spark):
    d = H.docs(spark, ["der die das und ist", "the and of to", None, "123 ...", "", H.LONG, (1, "the and of to")], lang={0: "de", 1: "en", 2: None})
    p = language.learn(d.limit(3))
    assert set(p) <= {"de", "en"}
    got = language.predict(H.clashing(d), language.learn(d), ["doc_id"])
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got.collect()}
    assert by[2] == by[3] == by[4] == ("und", 0.0) and by[0][0] == "de" and 0 < by[5][1] <= 1
    assert {r["lang_pred"] for r in language.predict(d, {}, ["doc_id"]).collect()} == {"und"}
    assert language.predict(H.docs(spark, []), p, ["doc_id"]).count() == 0 and language.learn(H.docs(spark, [])) == {}


def article(h):
    """The given pages' articles, by their plain marks."""
    import html
    import re

    parts = re.split(r"</?(?:p|h1)>", h[h.find("<article>") + 9 : h.find("</article>")])
    lines = [" ".join(html.unescape(re.sub(r"<[^>]+>", " " if "<br>" in x else "", x)).split()) for x in parts]
    return "\n".join(x for x in lines if x)


def test_extraction_of_given_pages(spark):
    want = {r["page_id"]: article(r["html"]) for r in table(spark, oracle.DATA, "pages").collect()}
    assert {r["page_id"]: r["text"] for r in wrappers.op6_html_extraction(spark, oracle.DATA).collect()} == want


PAGE = """<html><head><title>T {i}</title><style>p{{}}</style></head><body><div id=top class="site-header">Logo</div><div class=cookie-notice>We use cookies</div>
<ul class="menu"><li><a href=/a>Home {i}</a><li><a href=/b>News</a></ul><div id=wrap><div class=x1><p>Fixed teaser everywhere</div><div class=x2><h1>Title {i} &amp; more</h1><p>First {i}  para &copy;
 graph<p>Second <b>bold {i}</b> text<script>var x = "<p>no</p>"</script><form><p>Your mail <input></form>{more}</div><div class="comments"><p>reader {i} says</div></div>
<div class="sidebar">Side {i} bar</div><!-- gone --><footer>foot {i}</footer></body></html>"""


def pages(spark, n, more=lambda i: "", host="h"):
    return spark.createDataFrame([(i, f"http://{host}/p{i}", PAGE.format(i=i, more=more(i))) for i in range(n)], "page_id long, url string, html string")


def test_wrapper_without_marks_of_an_article(spark):
    got = {r["page_id"]: r["text"] for r in wrappers.extract(H.clashing(pages(spark, 12, lambda i: "".join(f"<p>Extra {i} {k}" for k in range(i))))).collect()}
    for i, t in got.items():
        assert t.split("\n") == [f"Title {i} & more", f"First {i} para © graph", f"Second bold {i} text", *[f"Extra {i} {k}" for k in range(i)]]


def test_copies_are_no_template(spark):
    same = spark.createDataFrame([(100 + i, "http://h/c", PAGE.format(i=7, more="<p>One more line of the copied article")) for i in range(40)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrappers.extract(pages(spark, 12).unionByName(same)).collect()}
    assert all(got[100 + i].startswith("Title 7 & more\nFirst 7 para") for i in range(40))


def extracted(spark, htmls, host="h"):
    rows = [(i, f"http://{host}/p{i}", h) for i, h in enumerate(htmls)]
    return [r["text"] for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_wrapper_says_where_the_text_is_not_the_article_tag(spark):
    page = "<body><div class=x1><h2>Fixed heading</h2><article><p>First part {i}, long enough to be text of this page</article><article><p>Second part {i}, also long enough to be such a text</article></div><div class=x3><article><p>On all pages</article></div></body>"
    assert extracted(spark, [page.format(i=i) for i in range(12)]) == [f"First part {i}, long enough to be text of this page\nSecond part {i}, also long enough to be such a text" for i in range(12)]
    some = "<body><div class=x1><article><p>Part {i}.0, long enough to be a text of this page<p>And {i}</article>{more}</div></body>"
    more = "<article><p>Part {i}.{k}, long enough to be a text of this page</article>"
    got = extracted(spark, [some.format(i=i, more="".join(more.format(i=i, k=k) for k in range(1, 1 + i % 3))) for i in range(12)])
    assert [t.count("Part") for t in got] == [1 + i % 3 for i in range(12)]


def test_articles_of_readers_and_several_articles_without_a_wrapper(spark):
    long = "a reader says so " * 20
    got = extracted(spark, [f"<body><div class=content><p>Text</div><div class=comments><article><p>{long}</article></div>", f"<article><p>One</article><article><p>Two two</article><article class=comment><p>{long}</article>"])
    assert got == ["Text", "One\nTwo two"]


@pytest.mark.parametrize("first", [100, 0])
def test_a_thousand_copies_are_no_template(spark, first):
    page = "<body><div class=top>Site</div><div class=x1><span>Day {d}</span><div>Body {i} begins and is long enough to be told from others</div><ul><li>Point {i} of the list</ul></div></body>"
    copies = 100 - first
    rows = [(first + i, "http://h/p", page.format(d=i, i=i)) for i in range(12)] + [(copies + 1000 * (not first) + k, "http://h/c", page.format(d=1000 + k, i=77)) for k in range(1000)]
    got = [r["text"] for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert len(got) == 1012 and all("Body" in t and "Point" in t and "Site" not in t for t in got)


def test_deep_and_wide_references(spark):
    deep = ["<div>" * 2000 + f"text {i}" + "</div>" * 2000 for i in range(5)]
    assert extracted(spark, deep) == [f"text {i}" for i in range(5)]
    a, b = (dom.parse("<table>" + "".join(f"<tr><td>{k}<td>b<td><p>c</p>" for k in range(n)) + "</table>") for n in (3000, 2900))
    n, pairs = dom.match(a, b)
    assert n == len(pairs) == 2 + 5 * 2900


def plain_match(a, b):
    x, y = dom.slots(a), dom.slots(b)
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, (kx, nx) in enumerate(x):
        for j, (ky, ny) in enumerate(y):
            w = 0 if kx.strip() != ky.strip() else min(len(nx), len(ny)) if kx == ky and kx[-1] != " " else plain_match(nx[0], ny[0])
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + w)
    return 1 + best[-1][-1]


def test_matching_equals_plain_matching():
    rng = np.random.default_rng(1)

    def tree(depth):
        return "".join(f"<{t}>{tree(depth - 1)}</{t}>" for t in rng.choice(["div", "section", "ul"], rng.integers(0, 5))) if depth else ""

    for _ in range(200):
        a, b = dom.parse(tree(3)), dom.parse(tree(3))
        n, pairs = dom.match(a, b)
        assert n == len(pairs) == len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == plain_match(a, b)
        met = {(id(x), id(y)) for x, y in pairs}
        assert all((id(x.parent), id(y.parent)) in met for x, y in pairs[1:])


def test_salted_references_give_the_same(spark, monkeypatch):
    want = H.collected(wrappers.extract(pages(spark, 12)), "page_id", "text")
    monkeypatch.setattr(wrappers, "BROADCAST_ROWS", 0)
    assert H.collected(wrappers.extract(pages(spark, 12)), "page_id", "text") == want


def test_extraction_odd_rows(spark):
    rows = [(1, None, None), (2, "x", ""), (3, None, "plain &lt;text&gt;"), (4, "http://h/", "<p>un<b>closed <div"), (4, "http://h/", "<p>un<b>closed <div"), (5, "::", "<script>never ends"), (6, "http://h/", "<div>" * 3000 + "deep" + "</div>" * 10), (7, "u", "<article>a<br>b<p>c</article>d"), (None, "u", "<main>m</main>")]
    got = collections.defaultdict(list)
    for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        got[r["page_id"]].append(r["text"])
    assert got == {1: [""], 2: [""], 3: ["plain <text>"], 4: ["unclosed"] * 2, 5: [""], 6: ["deep"], 7: ["a b\nc"], None: ["m"]}
    assert wrappers.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_matching_counts():
    a, b = dom.parse("<ul><li>1<li>2<li>3</ul><p>x"), dom.parse("<div></div><ul><li>1<li>2</ul><p>y<p>z")
    n, pairs = dom.match(a, b)
    assert n == len(pairs) == 5 and [x.tag for x, _ in pairs] == ["", "ul", "li", "li", "p"]


def test_pipeline_by_hand(spark):
    """The stages' plain versions, one after another."""
    import corpus_pipeline as c
    from orderlake.llm import quality

    docs = [r.asDict() for r in table(spark, oracle.DATA, "documents").collect()]
    fine = {r["doc_id"] for r in quality.ledger(table(spark, oracle.DATA, "documents")).where("fail_bits = 0").collect()}
    docs = [d for d in docs if d["doc_id"] in fine]
    first = {}
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        first.setdefault(d["text"].translate(H.LOWER), d)
    docs = list(first.values())
    comp = H.classes([(d["doc_id"], d["text"]) for d in docs], 5, 80, 100)
    docs = [d for d in docs if comp[d["doc_id"]][1] == d["doc_id"]]
    n = collections.Counter(d["source"] for d in docs)
    q = {s: v**0.5 for s, v in n.items()}
    want = collections.Counter()
    for d in docs:
        mean = q[d["source"]] / sum(q.values()) * len(docs) / n[d["source"]]
        u = int(hashlib.md5(f"mix-1:{d['doc_id']}:1".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, np.exp(-mean)
        total = p
        while u >= total:
            k += 1
            p *= mean / k
            total += p
        want[d["doc_id"]] = k
    sp = pieces.pieces(pieces.model_path()).sp
    text = {d["doc_id"]: d["text"] for d in docs}
    got = collections.Counter()
    for r in c.run(spark, oracle.DATA).collect():
        got[r["doc_id"]] += 1
        ids = [1, *sp.encode(text[r["doc_id"]]), 2]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()))
    assert got == +want
    for name, stage in c.STAGES[:-1]:
        assert set(stage(spark, H.clashing(H.docs(spark, [])), oracle.DATA).columns) >= set(c.COLUMNS), name


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls, empty and long texts, ties, repeated rows, missing doc_ids, clashing columns, through all stages."""
    import corpus_pipeline as c
    from orderlake.llm.common import cut

    good = " ".join(f"word{i} of{i * 7}" for i in range(60))
    rows = [(1, None), (2, ""), (3, good), (3, good), (None, good + " more"), (5, H.LONG), (6, good.upper()), (7, good + " end"), (8, "too short"), (9, H.LONG.replace("word5 ", "other "))]
    d = H.clashing(H.docs(spark, rows)).withColumn("source", F.when(F.col("doc_id") == 5, None).otherwise(F.col("source")))
    stays = {"quality rules": [3, 3, 5, 6, 7, 9, None], "exact dedup": [3, 3, 5, 7, 9, None], "n-gram Jaccard join": [3, 3, 5, None]}
    for name, stage in c.STAGES[:-1]:
        d = cut(stage(spark, d, oracle.DATA))
        assert d.columns == c.COLUMNS
        got = [r["doc_id"] for r in d.collect()]
        if name in stays:
            assert sorted(got, key=lambda x: (x is None, x or 0)) == stays[name], name
        else:
            assert set(got) <= {3, 5, None} and got.count(3) % 2 == 0
    assert c.STAGES[-1][1](spark, d, oracle.DATA).count() == d.count()


def stripped(page):
    """Without what names the parts: article, main, class, id and role."""
    return re.sub(r"\s(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", re.sub(r"<(/?)(article|main)\b", r"<\1div", page, flags=re.I), flags=re.I)


def test_two_pages_of_a_host_make_a_wrapper(spark):
    """On hosts of two pages or more, the texts are those of the pages without any names."""
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    several = pages.join(pages.groupBy(wrappers.host().alias("h")).count().where("count > 1"), wrappers.host() == F.col("h")).select("page_id", "url", "html")
    rows = several.collect()
    bare = spark.createDataFrame([(r["page_id"], r["url"], stripped(r["html"])) for r in rows], several.schema)
    assert len(rows) > 200 and H.collected(wrappers.extract(bare), "page_id", "text") == H.collected(wrappers.extract(several), "page_id", "text")


def test_an_articles_own_header_is_kept():
    page = "<body><header><h1>Site</h1></header><article><header><h1>Headline</h1></header><p>x y</p><footer>tags</footer></article><article class='comment'><header>Bob</header></article></body>"
    assert wrappers.main_text(page, None, None) == "Headline\nx y"
    assert wrappers.main_text(page.replace("<article><header", "<article><header class='share'"), None, None) == "x y"
