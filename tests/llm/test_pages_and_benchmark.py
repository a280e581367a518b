"""Decontamination and HTML extraction against brute force, and the pipeline against its stages."""

import html
import re

import pyarrow as pa
import pytest
from cases import awkward, frame, row, sentence
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from lumenframe.llm import decontamination as d
from lumenframe.llm import html_text, queries


def brute_tiles(doc, item, least):
    """Greedy string tiling by looking at all pairs of places."""
    free_doc, free_item, out = [True] * len(doc), [True] * len(item), []
    while True:
        best, found = least - 1, []
        for j in range(len(item)):
            for i in range(len(doc)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and free_doc[i + n] and free_item[j + n]:
                    n += 1
                if n > best:
                    best, found = n, []
                if n == best and n >= least:
                    found.append((i, j))
        if best < least:
            return out
        for i, j in found:
            if all(free_doc[i : i + best]) and all(free_item[j : j + best]):
                free_doc[i : i + best] = free_item[j : j + best] = [False] * best
                out.append((i, j, best))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=24), st.lists(st.sampled_from("abc"), max_size=14), st.integers(2, 4))
def test_tiles_are_greedy(doc, item, least):
    hashes = [d.words(pa.array([" ".join(x)], pa.string()))[0] for x in (doc, item)]
    assert d.tiles(*hashes, least) == brute_tiles(doc, item, least)


BENCH = [(1, sentence(1, 30)), (2, sentence(2, 40)), (3, "too short"), (4, None), (5, ""), (2, sentence(2, 40))]


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


@pytest.mark.parametrize("block_bytes", [100, 4_000_000])
def test_matches_by_brute_force(spark, block_bytes):
    a, b = BENCH[0][1].split(), BENCH[1][1].split()
    moved = " ".join([*b[20:], *b[:20]])
    texts = [" ".join(["pre"] * 9 + a + ["post"] * 9), moved.upper(), " ".join(a[:14]), " ".join(a[:16]), " ".join(w if i % 3 else "zz" for i, w in enumerate(a)), "nothing here"]
    rows = [row(100 + i, t) for i, t in enumerate(texts)] + awkward()
    docs, bench = frame(spark, rows), spark.createDataFrame(BENCH, "item_id long, text string")
    want = []
    for r in rows:
        for item_id, t in BENCH:
            tiles = brute_tiles(words(r[1]), words(t), d.LEAST) if t and len(words(r[1])) < 1000 else []
            n = sum(x[2] for x in tiles)
            if tiles and n >= d.THRESHOLD * len(words(t)):
                want.append((r[0], item_id, len(words(t)), n))
    got = d.matches(docs, bench, block_bytes=block_bytes)
    assert sorted((r.doc_id, r.item_id, r.item_words, r.covered_words) for r in got.collect()) == sorted(want)
    assert {101, 100, 103} <= {r.doc_id for r in got.collect()} and 102 not in {r.doc_id for r in got.collect()}
    kept = d.drop_contaminated(docs, bench, block_bytes=block_bytes)
    assert kept.columns == docs.columns
    out = {w[0] for w in want}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in rows if r[0] not in out)


def test_long_words_are_told_apart(spark):
    a, b = "a" * 64, "b" * 64
    rows = [row(1, " ".join([a + b * 2 + a] * 6)), row(2, " ".join([b + a * 2 + b] * 6))]
    assert len({*d.words(pa.array([r[1] for r in rows]))[0].tolist()}) == 2
    bench = spark.createDataFrame([(9, rows[0][1], "k")], "item_id short, text string, item_key string")
    assert [(r.doc_id, r.item_id, r.coverage) for r in d.matches(frame(spark, rows), bench).collect()] == [(1, 9, 1.0)]


def test_equal_hashes_are_no_tile(spark, monkeypatch):
    """Words are hashed by their length alone; only those that are spelled alike are tiles."""
    plain = d.hashed_words

    def alike(*args):
        found = plain(*args)
        return d.Words(found.size.astype("uint64"), found.text, found.begin, found.size)

    monkeypatch.setattr(d, "hashed_words", alike)
    block = d.Block.of(["ab cd ef gh"])
    texts = pa.array(["ab cd ef gh", "zz cd ef gh"])
    assert [x[0] for x in d.found_in(texts, block, block.table(), d.LEAST, d.THRESHOLD)] == [0]


def test_a_run_that_all_items_have_brings_no_pair_about():
    items = [f"which of these is {sentence(i, 20)}" for i in range(50)]
    block = d.Block.of(items)
    assert len(block.met(d.runs(d.words(pa.array(["which of these is"]))[0], d.LEAST))) == 0
    found = list(d.found_in(pa.array(items), block, block.table(), d.LEAST, d.THRESHOLD))
    assert {(t, i) for t, i, *_ in found} >= {(i, i) for i in range(50)}


def test_empty_tables(spark):
    docs, bench = frame(spark, awkward()), spark.createDataFrame([], "item_id long, text string")
    assert d.matches(docs, bench).count() == 0 and d.drop_contaminated(docs, bench).count() == len(awkward())
    assert d.matches(frame(spark, []), spark.createDataFrame(BENCH, "item_id long, text string")).count() == 0


# Pages

PAGE = """<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style><script>var a="</p>{i}";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href=/>Home</a></li><li>More {i}</li></ul></nav><!-- {i} --><div class="ad">Buy {i}</div>
<div id="content"><h1>Head {i}</h1><p>One &amp; two{i}<br>three <b>bold</b>,\n then</p><p>Open {i}<p>Last &eacute; &#233; {i}</div>
<aside>Side {i}</aside><form>Name {i}</form><div class="comments"><p>Nice {i}</p></div><footer>&copy; {i}</footer></body></html>"""


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, grp string, text string")


def test_main_part_of_a_host_is_deduced(spark):
    rows = [(i, f"http://a.example/{i}", PAGE.format(i=i), "h", "g", "t") for i in range(8)]
    got = {r.page_id: r for r in html_text.extract(pages(spark, rows)).collect()}
    want = "Head {i}\nOne & two{i}\nthree bold, then\nOpen {i}\nLast é é {i}"
    assert {k: r.text for k, r in got.items()} == {i: want.format(i=i) for i in range(8)}
    assert all(r.n_chars == len(r.text) for r in got.values())


def article(page):
    body = page[page.find("<article>") + 9 : page.find("</article>")]
    blocks = [re.sub(r"\s+", " ", html.unescape(x)).strip() for x in re.split(r"</?(?:p|h1|br)>", re.sub(r"</?b>", "", body))]
    return "\n".join(x for x in blocks if x)


def neutral(page):
    """The page with neutral elements and without class names, ids and roles."""
    page = re.sub(r"<(/?)(?:article|nav|aside|footer|header|main)\b", r"<\1div", page)
    return re.sub(r"\s(?:class|id|role)=(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", page)


@pytest.mark.parametrize("change", [lambda h: h, neutral])
def test_articles_of_the_small_table(spark, sf_dir, change):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    given = spark.createDataFrame([(r.page_id, r.url, change(r.html)) for r in rows], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.extract(given).collect()} == {r.page_id: article(r.html) for r in rows}


def test_the_template_holds_the_article(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select(html_text.F.lit("x").alias("host"), "html")
    assert html_text.templates(p).first().root == "/html[1]/body[1]/article[1]"


def slots(*rows):
    return {t: html_text.Slot((pages, vector), kinds, chars, links) for t, pages, vector, kinds, chars, links in rows}


def test_classes_nest_in_a_template():
    given = slots(
        ("", 10, 1, 10, 9000, 0), ("/b[1]", 10, 1, 10, 9000, 0), ("/b[1]/div[1]", 10, 1, 10, 8000, 0),
        ("/b[1]/div[1]/h3[1]", 7, 5, 7, 200, 0),  # alone on its pages: data
        ("/b[1]/div[2]", 6, 4, 1, 60, 0), ("/b[1]/div[2]/div[1]", 6, 4, 1, 30, 0), ("/b[1]/div[2]/div[2]", 6, 4, 1, 30, 0),
        ("/x[1]/y[1]", 5, 3, 1, 1, 0), ("/x[1]/y[2]", 5, 3, 1, 1, 0), ("/x[1]/y[3]", 5, 3, 1, 1, 0),  # in no valid class
    )
    assert html_text.template(given) == {t for t in given if "/x" not in t and "h3" not in t}
    assert html_text.decided(given)[0] == "/b[1]/div[1]"


def test_a_changing_heading_is_not_left_behind():
    given = slots(("", 10, 1, 10, 9000, 0), ("/div[1]", 10, 1, 10, 8800, 0), ("/div[2]", 10, 1, 3, 200, 0), ("/div[1]/h1[1]", 10, 1, 10, 300, 0), ("/div[1]/div[1]", 10, 1, 10, 8400, 0), ("/div[1]/div[2]", 10, 1, 1, 100, 0))
    assert html_text.decided(given) == ("/div[1]", ["/div[1]/div[2]"])


SITE = """<div><div><a href=/{i}>Go {i}</a> <a href=/>All of it</a></div><div>Offer {k} of the week</div></div>
<div><div><h2>Title {i}</h2><div>{body}</div><div>Share this with the people you know</div><div><a href=/{i}>Read {i} next</a></div></div></div><div>Made by host {k}</div>"""


def test_neutral_parts_go_by_the_template(spark):
    rows = [(i, f"http://n.example/{i}", SITE.format(i=i, k=i % 3, body=f"<p>{sentence(i, 30)}</p><p>{sentence(i + 50, 30)}</p>"), "h", "g", "t") for i in range(12)]
    got = {r.page_id: r.text for r in html_text.extract(pages(spark, rows)).collect()}
    assert got == {i: f"Title {i}\n{sentence(i, 30)}\n{sentence(i + 50, 30)}" for i in range(12)}


def test_marked_wrappers_keep_their_text(spark):
    page = "<body class='no-sidebar'><div id=content class='social science'><h1>T {i}</h1><p>{body}</p></div><div class=sidebar>Side</div></body>"
    rows = [(i, "http://w.example/", page.format(i=i, body=sentence(i, 30)), "h", "g", "t") for i in range(6)]
    got = {r.page_id: r.text for r in html_text.extract(pages(spark, rows)).collect()}
    assert got == {i: f"T {i}\n{sentence(i, 30)}" for i in range(6)}


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a<p>b", "a\nb"), ("<script>x", ""), ("a<!-- b", "a"), ("<div title='a>b'>c</div>", "c"),
        ("<article>x<nav>y</nav><footer>z</footer></article>w", "x"), ("1 < 2 & 3 &gt; 2", "1 < 2 & 3 > 2"), ("</p></div>q", "q"), ("<p></p>", ""),
    ],
)
def test_odd_markup(spark, page, text):
    got = html_text.extract(pages(spark, [(1, None, page, "h", "g", "t"), (1, None, page, "h", "g", "t")])).collect()
    assert [(r.text, r.n_chars) for r in got] == [(text, len(text))] * 2


def test_no_pages(spark):
    assert html_text.extract(pages(spark, [])).count() == 0


# Pipeline


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns
        docs = corpus_pipeline.stored(out, "test")
        now = {r.doc_id for r in docs.collect()}
        assert now < ids or name == "near_dedup" and now <= ids
        ids = now
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in got} == set(texts) and all(r.round_trip for r in got)
    assert len(set(texts.values())) == len(texts)
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages_of_awkward_rows(spark, sf_dir):
    docs = frame(spark, awkward())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
        assert stage(spark, frame(spark, []), sf_dir).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == len(awkward())
