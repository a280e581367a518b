"""Main text of web pages by equivalence-class template deduction.

The tokens of a page are its structural elements, told apart by the path of names, classes and ids above them and by their
place among alike siblings, so a token is on a page once or not at all. Over the pages of a host, each token has an
occurrence vector: the pages that it is on. Tokens with equal vectors form an equivalence class. Classes on most pages of
the host are large enough to be from its template: that of all pages, and others of MEMBERS tokens or more (a lone heading
that most pages have is data). One is valid if each of its elements lies in an element of its own or of a valid class; the
valid classes, nested, are the template, and what lies between its elements are the slots. Vectors are never gathered:
pages add to an order-free digest of each, and texts to a sketch of how many differ, so a host with a third of all pages
is no heavier for any task than another.

The slots decide where the main text is. From the page down, the search goes on into the element of the template that
holds most of the text that changes from page to page and isn't a link, as long as it leaves nothing of the kind behind:
no part with much changing text and no heading that changes. Of the template's elements below the one it ends at, those
whose text is the same on all pages go, those that are mostly links, and, if it ends at the body, those with few
different texts. Names have no say in this but between equals. Where the template can't tell (too few different pages, or
nothing more than the body), the page's own article or main element is taken, if it has one. At last, parts of the rest
that hold less than half of it and that their element, class, id or role names as menus, footers, sidebars, notices,
adverts, forms or comments go. Hosts with few pages share one template.

Defined cases: a null html gives an empty text; a page without the template's element is read from its own article, main
or body; text in no element counts as the body's; a null url is a host of its own; broken markup is read as it stands, an
unclosed script or comment reaching to the page's end; elements deeper than DEEPEST count as the one they lie in; repeated
rows are extracted alike.
"""

from __future__ import annotations

import html as entities
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from hashlib import blake2b
from zlib import crc32

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.joins import left_join_hot
from lumenframe.llm.text import slices
from lumenframe.storage import stored

#: Different pages that a template needs, the share of them that a class must be on, and the tokens that one not on all needs.
PAGES, FREQUENT, MEMBERS = 4, 0.5, 3
#: Share of the changing text that the main element must hold, and share of its own that a part left behind may have.
MOST, LESS = 0.5, 0.3
#: A part with fewer different texts than this share of the different pages repeats.
VARIED = 0.5
#: Templates to broadcast at most; more are joined by host.
FEW_TEMPLATES = 20_000
#: Depth from which elements aren't told apart, and the size of a sketch as a power of two.
DEEPEST, SKETCH = 64, 10
#: Bits of the lower half of a page's digest of forty bits.
HALF = 20

# Names of HTML elements by what they mean for a text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
INLINE |= frozenset("math mi mo mn ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mstyle mspace mpadded mphantom semantics annotation".split())
RAW = frozenset("script style noscript template textarea title svg iframe object canvas head".split())
APART = frozenset("nav footer aside form button select dialog menu".split())
MAIN = frozenset("article main".split())
ITEMS = frozenset("p li dt dd option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of a class, id or role that mark a part as not the article.
MARKS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu menubar modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted related respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
TOKEN = regex.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(?P<close>/?)(?P<name>[a-z][^\s/>\"'<]*+)",
    regex.S | regex.I,
)
#: Elements whose content is no markup, and what is between a tag's name and its end.
CLOSED = regex.compile(r"(?:script|style|noscript|template|textarea|title|svg|iframe)\b", regex.I)
REST = regex.compile(r"(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+>", regex.S)
SIGNS = regex.compile(r"[\"'>]")
#: Names and marks of more characters are told apart by a digest.
LONG_NAME = 120
NAMED = regex.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", regex.I)
SPACES = regex.compile(r"\s+")
WORDS, NAME = regex.compile(r"[a-z0-9]+"), regex.compile(r"[^.\[]*")


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url.cast("string"), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


@dataclass
class Page:
    """The elements of a page in the order they open, the page itself first, and its runs of text.

    An element has the path of its token (of the one it lies in, if it has none), whether it has one, the element it lies
    in, its name, and whether its names mark it. A run has its text, its element and whether it is in a link; without a text it ends a block.
    """

    paths: list[str] = field(default_factory=lambda: [""])
    tokens: list[bool] = field(default_factory=lambda: [True])
    above: list[int] = field(default_factory=lambda: [0])
    names: list[str] = field(default_factory=lambda: [""])
    marked: list[bool] = field(default_factory=lambda: [False])
    runs: list[tuple[str | None, int, bool]] = field(default_factory=list)


class Tags:
    """Where tags end. What was passed once isn't looked at again: a page is read in time linear in its length.

    A tag ends at the first ``>`` outside of quotes, and there may be none. Once that happened, the ends as seen from each
    sign (quote or ``>``) of the page are worked out from the last sign back, one step each.
    """

    def __init__(self, text: str) -> None:
        self.text, self.signs, self.ends = text, None, None

    def end(self, at: int) -> int:
        """The place behind the tag whose name ends at ``at``; -1 if it has no end."""
        if self.ends is None:
            m = REST.match(self.text, at)
            if m:
                return m.end()
            self.signs = [m.start() for m in SIGNS.finditer(self.text)]
            self.ends, following = [-1] * (len(self.signs) + 1), {}
            for k in range(len(self.signs) - 1, -1, -1):
                sign = self.text[self.signs[k]]
                if sign == ">":
                    self.ends[k] = self.signs[k] + 1
                else:
                    other = following.get(sign)  # the next one of its kind closes a quote
                    self.ends[k] = self.ends[other + 1] if other is not None else -1
                    following[sign] = k
        return self.ends[bisect_left(self.signs, at)]


def short(name: str) -> str:
    return name if len(name) <= LONG_NAME else blake2b(name.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def parsed(text: str) -> Page:
    page, at, seek, linked, alike, tags = Page(), 0, 0, False, defaultdict(int), Tags(text)
    stack, add = [0], page.runs.append
    names, paths = page.names, page.paths
    opened: dict[str, list[int]] = defaultdict(list)  # where in the stack elements of a name are
    closers: dict[str, int] = {}  # where the content of an element without markup was last seen to end

    def close(name: str, stop: Iterable[str] = ()) -> None:
        if not opened[name]:
            return
        i = opened[name][-1]
        if name == "p" and stop:
            if i < len(stack) - 1:
                return
        elif any(opened[x] and opened[x][-1] > i for x in stop):
            return
        for k in range(len(stack) - 1, i - 1, -1):
            opened[names[stack[k]]].pop()
        del stack[i:]

    def content_end(name: str, start: int) -> int:
        """Behind the closing tag, the page's end without one; what has none from one place on has none from later ones."""
        if closers.get(name) == -1:
            return len(text)
        m = regex.compile(rf"</{name}\s*+>", regex.I).search(text, start)
        closers[name] = m.end() if m else -1
        return m.end() if m else len(text)

    while m := TOKEN.search(text, seek):
        name, end = (m["name"] or "").lower(), m.end()
        if name:
            end = tags.end(m.end())
            if end < 0:  # no tag
                seek = m.end()
                continue
        if m.start() > at:
            add((text[at : m.start()], stack[-1], linked))
        at = seek = end
        if not name:
            continue
        whole = None if m["close"] else CLOSED.match(name)
        if whole:
            at = seek = content_end(whole[0], end)
            continue
        if name in INLINE:
            if name == "a":
                linked = not m["close"]
            continue
        add((None, stack[-1], False))
        if name in VOID:
            continue
        if m["close"]:
            close(name)
            continue
        if name in ITEMS or name in ("td", "th", "tr"):  # an open one of the kind ends here
            close(name, {"p": ["p"], "li": ["ul", "ol"], "option": ["select"]}.get(name, ["table", "dl"]))
        marks: list[str] = []
        rest = text[m.end() : end - 1]
        for _, a, b, c in NAMED.findall(rest) if rest else ():
            marks += WORDS.findall((a or b or c).lower())
        up, path, own = stack[-1], paths[stack[-1]], name not in ITEMS and len(stack) < DEEPEST
        if own:
            path = f"{path}/{short(name)}" + short("".join(f".{x}" for x in marks if not x.isdigit()))
            alike[path] += 1
            path = f"{path}[{alike[path]}]"
        paths.append(path)
        page.tokens.append(own)
        page.above.append(up)
        names.append(name)
        page.marked.append(name in APART or name in RAW or not MARKS.isdisjoint(marks))
        opened[name].append(len(stack))
        stack.append(len(paths) - 1)
    if at < len(text):
        add((text[at:], stack[-1], linked))
    return page


#: Texts of an element, in order, are a number in this base and modulus.
BASE, MODULUS = 1_000_003, 1 << 61


def weighed(page: Page) -> tuple[list[int], list[int], list[int]]:
    """Characters outside and in links, and a digest of the texts in order, of each element with all that lie in it.

    An element's texts are neighbours in the page's order, so its digest is that of a span of them.
    """
    n = len(page.paths)
    chars, links, low, high, upto, power = [0] * n, [0] * n, [-1] * n, [-1] * n, [0], [1]
    for text, at, linked in page.runs:
        text = text and text.strip()
        if not text or page.names[at] in RAW:
            continue
        (links if linked else chars)[at] += len(text)
        k = len(upto) - 1
        low[at] = k if low[at] < 0 else low[at]
        high[at] = k + 1
        upto.append((upto[-1] * BASE + crc32(text.encode("utf-8", "surrogatepass")) + 1) % MODULUS)
        power.append(power[-1] * BASE % MODULUS)
    for i in range(n - 1, 0, -1):
        up = page.above[i]
        chars[up] += chars[i]
        links[up] += links[i]
        if high[i] >= 0:
            low[up] = low[i] if low[up] < 0 else min(low[up], low[i])
            high[up] = max(high[up], high[i])
    seen = [(upto[b] - upto[a] * power[b - a]) % MODULUS if b >= 0 else 0 for a, b in zip(low, high)]
    return chars, links, seen


def token_table(pages: DataFrame) -> DataFrame:
    """For each host and token: pages it is on, digest of its vector in two halves, characters outside and in links, sketch of its texts.

    The token of the page itself is empty.
    """
    names = ["host", "token", "vector", "chars", "links", "text"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            rows: list[tuple] = []
            for host, source in zip(part.column("host").to_pylist(), part.column("html").fill_null("").to_pylist()):
                if not source:
                    continue
                page = parsed(source)
                chars, links, seen = weighed(page)
                who = int.from_bytes(blake2b(source.encode("utf-8", "surrogatepass"), digest_size=5).digest(), "little")
                rows += [(host, page.paths[i], who, chars[i], links[i], seen[i]) for i in range(len(page.paths)) if page.tokens[i]]
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string(), pa.string(), *[pa.int64()] * 4])], names)

    found = pages.select("host", "html").mapInArrow(run, "host string, token string, vector long, chars long, links long, text long")
    halves = [F.sum(F.col("vector").bitwiseAND((1 << HALF) - 1)).alias("low"), F.sum(F.shiftright("vector", HALF)).alias("high")]  # sums far below 64 bits
    sums = [*halves, *[F.sum(c).alias(c) for c in ("chars", "links")]]
    return found.groupBy("host", "token").agg(F.count("*").alias("pages"), *sums, F.hll_sketch_agg("text", SKETCH).alias("texts"))


def parent_of(token: str) -> str:
    return token.rpartition("/")[0]


def name_of(token: str) -> str:
    return NAME.match(token.rpartition("/")[2])[0]


@dataclass
class Slot:
    """What a token's class is, and what is known of the text in its element."""

    vector: tuple[int, int]
    kinds: int
    chars: int
    links: int

    @property
    def changing(self) -> int:
        return self.chars if self.kinds > 1 else 0


def template(slots: dict[str, Slot]) -> set[str]:
    """The tokens of the valid classes. Larger classes come first; a class that isn't nested in what is valid goes."""
    classes: dict[tuple[int, int], list[str]] = defaultdict(list)
    for token, slot in slots.items():
        classes[slot.vector].append(token)
    valid: set[str] = set()
    for vector, tokens in sorted(classes.items(), reverse=True):
        if vector != slots[""].vector and len(tokens) < MEMBERS:
            continue
        inside = valid.union(tokens)
        if all(not t or parent_of(t) in inside for t in tokens):
            valid = inside
    return valid


def decided(slots: dict[str, Slot]) -> tuple[str | None, list[str]]:
    """The token that holds the main text, None if the template can't tell, and the template's tokens in it that go."""
    page = slots.get("")
    if page is None or page.kinds < PAGES:
        return None, []
    frame = template(slots)
    within: dict[str, list[str]] = defaultdict(list)
    for t in frame - {""}:
        within[parent_of(t)].append(t)
    linky = {t for t in slots if slots[t].links > slots[t].chars}
    headed = [t for t in slots if name_of(t) in HEADINGS and t not in linky and slots[t].kinds >= VARIED * page.kinds]

    def stays(part: str, much: float) -> bool:
        own = slots[part]
        varied = part not in linky and own.kinds >= VARIED * page.kinds
        return varied and own.changing > much or any(h == part or h.startswith(f"{part}/") for h in headed)

    root = ""
    while within[root]:
        best = max(within[root], key=lambda t: (slots[t].changing, name_of(t) in MAIN, t))
        much = LESS * slots[best].changing
        rest = slots[root].changing - sum(slots[t].changing for t in within[root])
        if slots[best].changing < max(1, MOST * page.changing) or rest > much or any(stays(t, much) for t in within[root] if t != best):
            break
        root = best
    outer = name_of(root) in ("", "html", "body")
    gone = []
    for t in frame:
        if t.startswith(f"{root}/") and t != root:
            own = slots[t]
            same = own.kinds <= 1 and name_of(t) not in HEADINGS
            repeats = outer and own.kinds < VARIED * page.kinds and own.chars < LESS * slots[root].changing
            if own.chars + own.links and (same or t in linky or repeats):
                gone.append(t)
    return (root if not outer else None), sorted(gone)


def templates(pages: DataFrame) -> DataFrame:
    """(host, pages, root, gone) of each host with a page that isn't empty; ``pages`` has host and html.

    Only tokens on most pages of a host (or of all hosts with few pages) are looked at together, so a task gets about
    as many as a page has elements.
    """
    found = stored(token_table(pages), "tokens")
    hosts = found.where("token = ''").select("host", F.when(F.col("pages") >= PAGES, F.col("host")).otherwise("*").alias("grp"), F.col("pages").alias("host_pages"))
    sums = [F.sum(c).alias(c) for c in ("pages", "low", "high", "chars", "links")]
    grouped = found.join(hosts.select("host", "grp"), "host").groupBy("grp", "token").agg(*sums, F.hll_sketch_estimate(F.hll_union_agg("texts")).alias("kinds"))
    grouped = stored(grouped, "groups")
    sizes = grouped.where("token = ''").select("grp", F.col("pages").alias("all_pages"))
    small = sizes.where("grp = '*'").first()  # all hosts with few pages: their tokens, which may be many, meet one number
    shared = grouped.where("grp = '*'").where(F.col("pages") >= FREQUENT * (small.all_pages if small else 0))
    frequent = grouped.where("grp <> '*'").join(sizes, "grp").where(F.col("pages") >= FREQUENT * F.col("all_pages")).drop("all_pages").unionByName(shared)

    def decide(rows: pd.DataFrame) -> pd.DataFrame:
        slots = {r.token: Slot((int(r.pages), (int(r.high) << HALF) + int(r.low)), int(r.kinds), int(r.chars), int(r.links)) for r in rows.itertuples()}
        root, gone = decided(slots)
        return pd.DataFrame({"grp": [rows.grp.iloc[0]], "root": [root], "gone": [gone]})

    told = frequent.groupBy("grp").applyInPandas(decide, "grp string, root string, gone array<string>")
    return stored(hosts.join(told, "grp", "left").select("host", "host_pages", "root", "gone"), "templates")


def main_text(source: str, root: str | None, gone: Iterable[str] = ()) -> str:
    """The text of the root's element, or of the page's own article, main or body, without what goes."""
    page, gone = parsed(source), set(gone or ())
    n = len(page.paths)
    starts = {i for i in range(n) if page.paths[i] == root and page.tokens[i]} if root else set()
    if not starts:
        starts = {i for i in range(n) if page.names[i] in MAIN} or {0}
    chars = [0] * n
    for text, at, _ in page.runs:
        if text:
            chars[at] += len(text.strip())
    for i in range(n - 1, 0, -1):
        chars[page.above[i]] += chars[i]
    inside = [False] * n
    held = [0] * n  # text of the start that an element lies in
    for i in range(n):
        up = page.above[i]
        if i in starts and not (i and inside[up]):
            inside[i], held[i] = True, chars[i]
        elif i and inside[up]:
            held[i] = held[up]
            header = page.names[i] == "header" and 0 in starts
            apart = page.names[i] in RAW or (page.marked[i] or header) and chars[i] < MOST * held[i]
            inside[i] = not apart and not (page.tokens[i] and page.paths[i] in gone)
    blocks: list[str] = []
    run: list[str] = []
    for text, at, _ in page.runs:
        if text is None:
            blocks.append("".join(run))
            run = []
        elif inside[at]:
            run.append(text)
    blocks.append("".join(run))
    clean = (SPACES.sub(" ", entities.unescape(b)).strip() for b in blocks)
    return "\n".join(b for b in clean if b)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    hosted = pages.select("page_id", "url", F.col("html").cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    table = templates(hosted)
    if table.count() <= FEW_TEMPLATES:
        met = hosted.join(F.broadcast(table.drop("host_pages")), "host", "left")
    else:
        met = left_join_hot(hosted, table, "host", "host_pages")
    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            columns = (part.column("html").fill_null("").to_pylist(), part.column("root").to_pylist(), part.column("gone").to_pylist())
            texts = [main_text(h, r, g) for h, r, g in zip(*columns)]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return met.select("page_id", "url", "html", "root", "gone").mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
