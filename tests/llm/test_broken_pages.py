"""Broken markup of any length is read in time linear in its length, and groups of any size have vectors."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lumenframe.llm import html_text

PIECES = "<a |<div>|</div>|<p>|</p>|<li>|<ul>|</ul>|\"|'|>|x|<td>|<table>|</td>|<script>|</script>|<!--|-->|<b>| class=\"q\"|<div class='z'>|<br/>|<h1>|</h1>|<math>|</math>".split("|")


@pytest.mark.parametrize("unit", ["<a ", '<a b="', "<a", "<a b=\"'<i c='", "<div>x", "<title ", "<td></td>", "</div>", "<!-", "<p class='a b'>", "<li><ul>", "</script", "<script ", "&amp;<", "<x y='>"])
def test_a_megabyte_takes_seconds(unit):
    took = []
    for size in (1 << 18, 1 << 20):
        began = time.process_time()
        page = html_text.parsed("<td><table>" + unit * (size // len(unit)))
        html_text.weighed(page)
        html_text.main_text(unit * (size // len(unit)), None)
        took.append(time.process_time() - began)
    assert took[1] < 30 and took[1] < 12 * max(took[0], 0.2)


def test_deep_pages_with_stray_closers():
    began = time.process_time()
    text = html_text.main_text("<div>" * 60_000 + "word" + "</span></em></p></h4>" * 40_000 + "</section>" * 40_000, None)
    assert text == "word" and time.process_time() - began < 30


def digests(page):
    """What weighed() has, by walking up from each text."""
    n = len(page.paths)
    chars, links, seen = [0] * n, [0] * n, [0] * n
    for text, at, linked in page.runs:
        text = (text or "").strip()
        if text and page.names[at] not in html_text.RAW:
            while True:
                (links if linked else chars)[at] += len(text)
                seen[at] = (seen[at] * html_text.BASE + html_text.crc32(text.encode()) + 1) % html_text.MODULUS
                if not at:
                    break
                at = page.above[at]
    return chars, links, seen


def test_weights_by_walking_up():
    r = random.Random(7)
    for _ in range(3000):
        page = html_text.parsed("".join(r.choice(PIECES) for _ in range(r.randint(0, 30))))
        assert html_text.weighed(page) == digests(page)


def test_ends_of_tags_by_scanning():
    r = random.Random(8)
    for _ in range(3000):
        text = "".join(r.choice("\"'>ab<") for _ in range(r.randint(1, 25)))
        tags = html_text.Tags(text)
        for at in sorted(r.randrange(len(text) + 1) for _ in range(6)):
            i, quote = at, ""
            while i < len(text) and (quote or text[i] != ">"):
                quote = "" if quote and text[i] == quote else text[i] if not quote and text[i] in "\"'" else quote
                i += 1
            assert tags.end(at) == (i + 1 if i < len(text) else -1)


def test_formulas_stay():
    page = "<html><body><article><p>Let <math><mi>x</mi><mo>&lt;</mo><mn>2</mn></math> be.</p><p>Then.</p></article></body></html>"
    assert html_text.main_text(page, None) == "Let x<2 be.\nThen."


def test_vectors_of_twenty_million_pages(spark):
    """Halves of the largest digest add up far below 64 bits, and make the sum that whole digests would have."""
    n, top = 20_000_000, (1 << 40) - 1
    rows = spark.range(n).select(F.lit(top).alias("vector"))
    low, high = rows.agg(F.sum(F.col("vector").bitwiseAND((1 << html_text.HALF) - 1)), F.sum(F.shiftright("vector", html_text.HALF))).first()
    assert (high << html_text.HALF) + low == n * top > 1 << 63


def test_very_long_names_are_told_apart():
    a, b = (html_text.parsed(f"<div class='{'w ' * 5000}{x}'><section>t</section></div>") for x in ("a", "b"))
    assert a.paths != b.paths and max(map(len, a.paths)) < 400
