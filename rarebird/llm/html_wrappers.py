"""HTML extraction with wrappers inferred per host.

A page is read as a balanced token stream: elements, named by tag and class, and
texts. Streams of one host are aligned into a union-free regular expression:
repeats that stand side by side become a repeated group, tokens that a stream
lacks become optional, texts that differ become slots and texts that never differ
stay constants. The wrapper of a host starts as its first page's expression and
is widened by one page after another; wrappers of parts of a host are aligned in
the same way, so hosts of any size are inferred in parallel and pages are read
where they lie.

A wrapper says which parts of a page are the host's template, and extraction reads a
page again along its host's wrapper to leave them out:

- regions that are mostly links;
- constants: texts that stand at one path on half of the host's pages or more, and on
  three at least; pages alike in text count once. They are counted for all texts at
  once, by host, path and text, so that no alignment can miss one. Where the wrapper
  has a repeated group and most of what stands there differs from page to page, the
  group is running text, and a paragraph that many pages share is kept;
- regions that markup names as not the article, by words that can mean something
  else as well ("social-history"), and forms, unless slots bear most of their text.

Markup whose only meaning is that it is not the article (nav, class "sidebar") is left
out everywhere. What is left in the elements that markup names as the article is the
result, or if that is nothing, what is left in the body. Pages of hosts with fewer
than three pages unlike in text have no slots to go by: there a doubtful region is
kept if it bears half of the page's text, or stands in the article and is no form.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html import unescape

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarebird.sources.staging import stage

# Elements by role, and words in class, id or role attributes that
# name parts outside the article.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "xmp")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav header footer aside form button select option dialog menu head object canvas audio video".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul "
    "caption option select br button".split()
)
MAIN = frozenset(("article", "main"))
OUTSIDE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation "
    "breadcrumb breadcrumbs sidebar aside footer header masthead notice notices cookie cookies consent gdpr alert popup modal "
    "overlay comment comments reply replies respond disqus form subscribe subscription newsletter signup login share sharing "
    "social related recommended widget toolbar search pagination pager skip copyright complementary contentinfo".split()
)
# Words that say where a part stands, and nothing of what it is.
LAYOUT = frozenset(
    "area article bar base big block blog body bottom box btn card cell center col column container content entry first fixed "
    "group holder inner item items last layout left list main mini mobile module outer page panel post region right row section "
    "site slot small sticky text title top unit user web wrap wrapper zone".split()
)
# Tags that an opening tag closes.
CLOSES = {
    "li": frozenset(("li",)),
    "dt": frozenset(("dt", "dd")),
    "dd": frozenset(("dt", "dd")),
    "tr": frozenset(("tr", "td", "th")),
    "td": frozenset(("td", "th")),
    "th": frozenset(("td", "th")),
    "option": frozenset(("option",)),
}
CLOSE_P = BLOCKS - frozenset(("br", "body", "html", "button", "option", "select"))
# End of the fixed values.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>"
    r"|<(" + "|".join(RAW) + r")\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>"
    r"|([^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_WORD = re.compile(r"[A-Za-z]+")
#: Elements nested deeper are read as if their tags were not there.
DEEPEST = 60
#: Pages of a host, unlike in text, that must agree before a text counts as its
#: template, and their share of all such pages.
TEMPLATE_PAGES = 3
TEMPLATE_SHARE = 0.5
#: Share of linked characters from which a region counts as a list of links.
LINKED = 0.6
#: Share of a doubtful region's text in slots from which it is part of the article.
SLOTS = 0.5
#: Share of constant text from which what stands at a repeated path is template.
CONSTANT = 0.5
#: Strength of the evidence that an element is outside the article.
DOUBTFUL, CERTAIN = 1, 2
#: Parts in which a host's wrappers are merged and its texts are joined to its number of pages.
PARTS = 32
#: Hosts whose wrappers a task holds before it passes them on.
HOSTS_HELD = 2_000
#: Items of one element that are aligned one by one. In wider elements the items of
#: one name are covered by one item, optional and repeated; none is left out.
WIDEST = 400


def _evidence(value: str) -> int:
    """How sure the words of a class, id or role are that an element is outside the article."""
    found = 0
    for one in value.lower().split():
        words = _WORD.findall(one)
        if not OUTSIDE.isdisjoint(words):
            found = max(found, CERTAIN if all(w in OUTSIDE or w in LAYOUT for w in words) else DOUBTFUL)
    return found


def _name(tag: str, attributes: str) -> tuple[str, int, bool]:
    """An element's name in a stream, how surely it is outside the article, whether it holds the article."""
    name, outside, main = tag, (DOUBTFUL if tag == "form" else CERTAIN) if tag in DROPPED else 0, tag in MAIN
    if attributes and "=" in attributes:
        for key, *values in _ATTRIBUTE.findall(attributes):
            value = next((v for v in values if v), "")
            words = [w.lower() for w in _WORD.findall(value)]
            if key.lower() == "class":
                name += "." + ".".join(words)
            if tag not in ("html", "body"):
                evidence = _evidence(value)
                if evidence == DOUBTFUL and key.lower() != "class":
                    name += "." + ".".join(words)  # so that wrappers tell it apart
                outside = max(outside, evidence)
                main = main or (key.lower() == "role" and "main" in words)
    return name, outside, main


def _doubtful(name: str) -> bool:
    """Whether an element of this name can be a doubtful region."""
    tag, *words = name.split(".")
    return tag == "form" or not OUTSIDE.isdisjoint(words)


def tokens(html: str) -> Iterator[tuple]:
    """("open", tag, name, outside, main), ("close", tag) and ("text", raw) in page order, balanced."""
    opened: list[str] = []
    for raw, slash, tag, attributes, text in _TOKEN.findall(html):
        if text:
            yield "text", text
        elif tag and not slash:
            tag = tag.lower()
            if tag in CLOSE_P and "p" in opened:
                yield from _shut(opened, "p")
            elif tag in CLOSES and opened and opened[-1] in CLOSES[tag]:
                yield from _shut(opened, opened[-1])
            name, outside, main = _name(tag, attributes)
            yield "open", tag, name, outside, main
            if tag in VOID or attributes.endswith("/"):
                yield "close", tag
            else:
                opened.append(tag)
        elif tag and tag.lower() in opened:
            yield from _shut(opened, tag.lower())
    while opened:
        yield "close", opened.pop()


def _shut(opened: list[str], tag: str) -> Iterator[tuple]:
    while True:
        last = opened.pop()
        yield "close", last
        if last == tag:
            return


# A wrapper's items are lists, so that they pass through JSON:
# element: [name, pages, optional, repeated, items]
# text:    ["#", pages, optional, repeated, constant or None, characters, linked characters]
def stream(html: str) -> list:
    """A page's items, its own repeats folded into groups."""
    root: list = []
    stack: list = [root]
    links = 0
    depth = 0
    for token in tokens(html):
        if token[0] == "open":
            depth += 1
            if token[1] == "a":
                links += 1
            if depth <= DEEPEST:
                item = [token[2], 1, False, False, []]
                stack[-1].append(item)
                stack.append(item[4])
        elif token[0] == "close":
            if depth <= DEEPEST:
                items = fold(stack.pop())
                stack[-1][-1][4] = items
            depth -= 1
            if token[1] == "a":
                links -= 1
        else:
            text = " ".join(unescape(token[1]).split())
            if text:
                stack[-1].append(["#", 1, False, False, text, len(text), len(text) if links else 0])
    return fold(root)


def fold(items: list) -> list:
    """Items with runs of equal groups of up to three replaced by one repeated group's items."""
    for period in (1, 2, 3):
        out: list = []
        i = 0
        while i < len(items):
            names = [x[0] for x in items[i : i + period]]
            end = i + period
            while len(names) == period and [x[0] for x in items[end : end + period]] == names:
                end += period
            if end > i + period and not (period == 1 and names == ["#"]):
                group = items[i : i + period]
                for at in range(i + period, end, period):
                    group = [_both(a, b, False) for a, b in zip(group, items[at : at + period])]
                out += [[*x[:3], True, *x[4:]] for x in group]
                i = end
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def _both(a: list, b: list, pages: bool) -> list:
    """The item that covers two items of one name; ``pages``: they stand for different pages."""
    n, optional, repeated = (a[1] + b[1] if pages else a[1]), a[2] or b[2], a[3] or b[3]
    if a[0] == "#":
        return ["#", n, optional, repeated, a[4] if a[4] == b[4] else None, a[5] + b[5], a[6] + b[6]]
    return [a[0], n, optional, repeated, align(a[4], b[4], pages)]


def align(left: list, right: list, pages: bool = True) -> list:
    """The items that cover both: a longest common subsequence, all else optional."""
    n, m = len(left), len(right)
    start = 0
    while start < min(n, m) and left[start][0] == right[start][0]:
        start += 1
    if (n - start) * (m - start) > WIDEST * WIDEST:
        return gathered(left, right, pages)
    longest = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, start - 1, -1):
        row, below = longest[i], longest[i + 1]
        for j in range(m - 1, start - 1, -1):
            row[j] = below[j + 1] + 1 if left[i][0] == right[j][0] else max(below[j], row[j + 1])
    out = [_both(a, b, pages) for a, b in zip(left[:start], right[:start])]
    i = j = start
    while i < n or j < m:
        if i < n and j < m and left[i][0] == right[j][0]:
            out.append(_both(left[i], right[j], pages))
            i, j = i + 1, j + 1
        elif j == m or (i < n and longest[i + 1][j] >= longest[i][j + 1]):
            out.append([*left[i][:2], True, *left[i][3:]])
            i += 1
        else:
            out.append([*right[j][:2], True, *right[j][3:]])
            j += 1
    out = fold(out)
    return out if len(out) <= WIDEST else gathered(out, [], pages)


def gathered(left: list, right: list, pages: bool) -> list:
    """One optional, repeated item for each name, which covers all items of that name on both sides."""
    sides: list[dict[str, list]] = [{}, {}]
    for side, items in zip(sides, (left, right)):
        for x in items:
            side[x[0]] = _both(side[x[0]], x, False) if x[0] in side else x
    one, two = sides
    whole = {k: _both(one[k], two[k], pages) if k in one and k in two else one.get(k) or two[k] for k in {**one, **two}}
    return [[*x[:2], True, True, *x[4:]] for x in whole.values()]


def expression(items: list) -> str:
    """A wrapper as a regular expression over tokens, to be read by people."""
    out = []
    for x in items:
        body = ("#text" if x[4] is None else repr(x[4])) if x[0] == "#" else f"<{x[0]}>{expression(x[4])}</{x[0]}>"
        out.append(f"({body}){'*' if x[2] else '+'}" if x[3] else f"({body})?" if x[2] else body)
    return "".join(out)


def template(items: list) -> dict:
    """What a wrapper says of its host's pages.

    ``constants`` has per path the texts that pages share, ``linked`` the regions in
    which links prevail, ``repeated`` the blocks that stand in repeated groups, and
    ``slots`` the doubtful regions whose text is mostly in slots. The wrapper of less than
    three pages says nothing.
    """
    pages = max((x[1] for x in items), default=0)
    if pages < TEMPLATE_PAGES:
        return {"constants": {}, "linked": []}
    constants: dict[str, set] = {}
    sums: dict[str, list[int]] = {}
    repeated: set[str] = set()

    def walk(some: list, path: str, dropped: bool) -> None:
        for x in some:
            if x[0] == "#":
                constant = x[4] is not None and x[1] >= max(TEMPLATE_PAGES, TEMPLATE_SHARE * pages)
                if constant:
                    constants.setdefault(path, set()).add(x[4])
                parts = path.split("/")
                for k in range(3, len(parts) + 1):
                    total = sums.setdefault("/".join(parts[:k]), [0, 0, 0, 0])
                    total[0] += x[5]
                    total[1] += x[6]
                    if not dropped:
                        total[2] += x[5]
                        total[3] += 0 if constant else x[5] - x[6]
            else:
                at, tag = f"{path}/{x[0]}", x[0].partition(".")[0]
                if x[3] and tag in BLOCKS:
                    repeated.add(at)
                walk(x[4], at, dropped or (tag in DROPPED and tag != "form"))

    walk(items, "", False)
    linked = [p for p, (chars, links, _, _) in sums.items() if links >= LINKED * chars and _is_block(p)]
    slots = [p for p, (*_, chars, free) in sums.items() if _doubtful(p.rpartition("/")[2]) and free and free >= SLOTS * chars]
    told = {p: sorted(t) for p, t in constants.items()}
    return {"constants": told, "linked": sorted(linked), "repeated": sorted(repeated), "slots": sorted(slots)}


def alone(html: str) -> frozenset[str]:
    """The doubtful regions that a page without a wrapper keeps, by path."""
    sums: dict[str, list[int]] = {}

    def walk(some: list, path: str) -> None:
        for x in some:
            if x[0] == "#":
                parts = path.split("/")
                for k in range(1, len(parts) + 1):
                    total = sums.setdefault("/".join(parts[:k]), [0, 0])
                    total[0] += x[5]
                    total[1] += x[5] - x[6]
            elif (tag := x[0].partition(".")[0]) not in DROPPED or tag == "form":
                walk(x[4], f"{path}/{x[0]}")

    walk(stream(html), "")
    whole = sums.get("", [0, 0])[1]
    kept = set()
    for path, (chars, free) in sums.items():
        above, _, name = path.rpartition("/")
        marked = not MAIN.isdisjoint(part.partition(".")[0] for part in above.split("/"))
        if free and (free >= SLOTS * whole or (marked and name.partition(".")[0] != "form" and free >= SLOTS * chars)):
            kept.add(path)
    return frozenset(kept)


def _is_block(path: str) -> bool:
    """Whether the path's last element is no part of a running text."""
    return re.match(r"[^.]*", path.rpartition("/")[2])[0] in BLOCKS


def _mark(path: str, text: str) -> int:
    """A text at a path as a number."""
    return xxhash.xxh3_64_intdigest(f"{path}\0{text}".encode("utf-8", "surrogatepass")) - (1 << 63)


def runs(html: str, keeps: Callable[[str], bool] = lambda path: True) -> Iterator[tuple[str, bool, list[tuple[str, str, bool]]]]:
    """The text between two edges of blocks: the block's path, whether in a marked article, and pieces.

    A piece is its own path, its text and whether it is linked. Pieces that are surely
    outside the article are left out, and those in doubtful regions that ``keeps`` refuses.
    """
    path, block, outs, mains, links = "", "", 0, 0, 0
    above: list[tuple[str, str, bool, bool]] = []
    pieces: list[tuple[str, str, bool]] = []
    for token in tokens(html):
        if token[0] == "text":
            if not outs:
                pieces.append((path, unescape(token[1]), links > 0))
            continue
        tag = token[1]
        if pieces and (tag in BLOCKS or (token[4] if token[0] == "open" else above[-1][3])):
            yield block, mains > 0, pieces
            pieces = []
        if token[0] == "open":
            _, _, name, evidence, main = token
            outside = evidence == CERTAIN or (evidence == DOUBTFUL and not outs and not keeps(f"{path}/{name}"))
            above.append((path, block, outside, main))
            outs += outside
            mains += main
            links += tag == "a"
            if len(above) <= DEEPEST:
                path = f"{path}/{name}"
            if tag in BLOCKS:
                block = path
        else:
            path, block, outside, main = above.pop()
            outs -= outside
            mains -= main
            links -= tag == "a"
    if pieces:
        yield block, mains > 0, pieces


def marks(html: str) -> tuple[int, dict[int, tuple[int, int]]]:
    """A page's text, and each run of text at its block and each block that is mostly links, as numbers.

    With each run go its block as a number and its characters. What its markup surely
    names as not the article does not count.
    """
    found: dict[int, tuple[int, int]] = {}
    content: list[str] = []
    sums: dict[str, list[int]] = {}
    for block, _, pieces in runs(html):
        text = " ".join("".join(t for _, t, _ in pieces).split())
        if text:
            found[_mark(block, text)] = (_mark(block, ""), len(text))
            content.append(text)
            total = sums.setdefault(block, [0, 0])
            total[0] += len(text)
            total[1] += sum(len(" ".join(t.split())) for _, t, linked in pieces if linked)
    if any(links for _, links in sums.values()):
        regions: dict[str, list[int]] = {}
        for at, (chars, links) in sums.items():
            while at:
                total = regions.setdefault(at, [0, 0])
                total[0] += chars
                total[1] += links
                at = at.rpartition("/")[0]
        found |= {_mark(at, ""): (_mark(at, ""), 0) for at, (chars, links) in regions.items() if links >= LINKED * chars}
    return _mark("", " ".join(content)), found


def main_text(html: str | None, left_out: dict | None = None) -> str:
    """The article of a page.

    The text without what is marked as outside and without the host's template: that
    of the article the page marks, or if there is none, the body's. A run of text is
    template as a whole, not by the words between its tags. In a marked article lists
    of links count as template only if the host's pages have them like a constant.
    ``left_out`` is what ``template`` says of the host's wrapper; without its ``slots``
    the page decides on its doubtful regions alone.
    """
    if not html:
        return ""
    constants = {p: set(t) for p, t in (left_out or {}).get("constants", {}).items()}
    linked = set((left_out or {}).get("linked", ()))
    counted = frozenset((left_out or {}).get("marks", ()))
    article: list[str] = []
    body: list[str] = []
    kept: list[frozenset] = [frozenset(left_out["slots"])] if left_out and "slots" in left_out else []

    def keeps(path: str) -> bool:
        if not kept:
            kept.append(alone(html))
        return path in kept[0]

    def listed(at: str, main: bool) -> bool:
        while at:
            if at in linked and (not main or _mark(at, "") in counted):
                return True
            at = at.rpartition("/")[0]
        return False

    for block, main, pieces in runs(html, keeps):
        text = " ".join("".join(t for _, t, _ in pieces).split())
        if not text or (linked and listed(block, main)) or (counted and _mark(block, text) in counted):
            continue
        if constants and all(not t.strip() or " ".join(t.split()) in constants.get(p, ()) for p, t, _ in pieces):
            continue
        (article if main else body).append(text)
    return " ".join(article or body)


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host and wrapper (JSON) of every host, from rows of host and html, staged."""

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}
        for frame in frames:
            for host, html in zip(frame["host"], frame["html"]):
                new = stream(html)
                held[host] = align(held[host], new) if host in held else new
            if len(held) > HOSTS_HELD:
                yield shown(held)
                held = {}
        if held:
            yield shown(held)

    def shown(held: dict[str, list]) -> pd.DataFrame:
        return pd.DataFrame({"host": list(held), "wrapper": [json.dumps(w) for w in held.values()]})

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [json.loads(w) for w in sorted(frame["wrapper"])]
        whole = parts[0]
        for part in parts[1:]:
            whole = align(whole, part)
        return shown({frame["host"].iloc[0]: whole})

    schema = "host string, wrapper string"
    known = pages.filter("host is not null and host <> '' and html is not null")
    # Each task passes on a wrapper a host; two rounds keep any one task's share small.
    parts = known.mapInPandas(first, schema).withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(PARTS)))
    some = parts.groupBy("host", "part").applyInPandas(merge, schema)
    return stage(some.groupBy("host").applyInPandas(merge, schema), "wrappers")


def template_marks(pages: DataFrame) -> DataFrame:
    """host, marks of its constant texts, and those that are few among what stands at their path.

    From rows of host and html. Counted are a host's pages that differ in text; a page's
    own number has the mark null. ``few`` has the blocks in which less than ``CONSTANT``
    of all text is constant, and the marks of that part. Hosts of fewer than three such
    pages, and those without any text, have no row.
    """

    def marked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            hosts: list = []
            of: list = []
            contents: list = []
            places: list = []
            for host, html in zip(frame["host"], frame["html"]):
                content, found = marks(html)
                hosts += [host] * (len(found) + 1)
                of += [None, *found]
                contents += [content] * (len(found) + 1)
                places += [(None, 0), *found.values()]
            at, chars = ([p[k] for p in places] for k in (0, 1))
            columns = {"host": hosts, "mark": pd.array(of, "Int64"), "content": contents, "block": pd.array(at, "Int64"), "chars": chars}
            yield pd.DataFrame(columns)

    found = pages.filter("host is not null and host <> '' and html is not null").mapInPandas(
        marked, "host string, mark long, content long, block long, chars long"
    )
    # Block and characters follow from the mark; one row a mark and page unlike in text.
    counts = found.distinct().groupBy("host", "mark", "block").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    counts = stage(counts, "text-counts")
    totals = counts.filter("mark is null").filter(F.col("n") >= TEMPLATE_PAGES)
    # A host may hold a third of all texts, so its texts are joined in parts, and summed there.
    every = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
    totals = totals.select(F.col("host").alias("whole"), F.col("n").alias("pages"), every.alias("of"))
    constant = (F.col("n") >= TEMPLATE_PAGES) & (F.col("n") >= TEMPLATE_SHARE * F.col("pages"))
    known = counts.filter("mark is not null")
    known = known.join(totals, (F.col("host") == F.col("whole")) & (F.pmod("mark", F.lit(PARTS)) == F.col("of")))
    # A host has no more constants than two of its pages have texts, so these lists are short.
    blocks = known.groupBy("host", "block").agg(
        F.sum("chars").alias("every"),
        F.sum(F.when(constant, F.col("chars"))).alias("shared"),
        F.collect_list(F.when(constant & (F.col("chars") > 0), F.col("mark"))).alias("texts"),
        F.collect_list(F.when(constant & (F.col("chars") == 0), F.col("mark"))).alias("lists"),
    )
    mixed = F.col("shared") < CONSTANT * F.col("every")
    few = F.when(mixed & (F.size("texts") > 0), F.struct("block", "texts"))
    return blocks.groupBy("host").agg(
        F.flatten(F.collect_list(F.concat("texts", "lists"))).alias("marks"), F.collect_list(few).alias("few")
    )


def main_texts(pages: DataFrame, html: str = "html", url: str = "url", id_column: str = "page_id") -> DataFrame:
    """Per row: the id, the url, text and n_chars.

    Null and empty pages have an empty text. Pages without a host in their url
    are read without a wrapper. Repeated rows are read each, and columns other than the
    three named are not looked at. A host's wrapper is inferred from all of its pages.
    """
    rows = pages.select(
        F.col(id_column).alias("id"),
        F.col(url).cast("string").alias("url"),
        F.lower(F.regexp_extract(F.col(url).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).alias("host"),
        F.col(html).cast("string").alias("html"),
    )

    def decide(wrappers: pd.Series, counted: pd.Series, few: pd.Series) -> pd.Series:
        out = []
        for wrapper, found, rare in zip(wrappers, counted, few):
            says = template(json.loads(wrapper))
            known = {"linked": says["linked"]}
            if found is not None and "slots" in says:
                groups = {_mark(path, "") for path in says["repeated"]}
                running = {m for r in rare if r["block"] in groups for m in r["texts"]}
                known |= {"slots": says["slots"], "marks": sorted(int(m) for m in found if m not in running)}
            out.append(json.dumps(known))
        return pd.Series(out, dtype=object)

    counted = template_marks(rows.select("host", "html")).withColumnRenamed("host", "at")
    wrappers = infer_wrappers(rows.select("host", "html")).join(counted, F.col("host") == F.col("at"), "left")
    wrappers = wrappers.select(F.col("host").alias("of"), F.pandas_udf(decide, "string")("wrapper", "marks", "few").alias("left_out"))

    def read(html: pd.Series, left_out: pd.Series) -> pd.Series:
        seen: dict = {}
        out = []
        for page, known in zip(html.tolist(), left_out.tolist()):
            if known is not None and known not in seen:
                seen[known] = json.loads(known)
            out.append(main_text(page, seen.get(known)))
        return pd.Series(out, dtype=object)

    joined = rows.join(stage(wrappers, "templates"), F.col("host") == F.col("of"), "left")
    text = F.pandas_udf(read, "string")("html", "left_out")
    return joined.select(F.col("id").alias(id_column), F.col("url").alias(url), text.alias("text")).withColumn(
        "n_chars", F.length("text").cast("long")
    )
