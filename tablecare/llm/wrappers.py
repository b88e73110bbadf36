"""Main text of web pages by wrappers inferred per host.

Pages of a host come from templates. Each page is read as a stream of block tags
and text slots; repeats within a page are folded to groups, and the streams of a
host are aligned one after the other. Where they differ, what is only on one side
becomes optional, and a group on one side takes the same, unrepeated tags on the
other. The outcome is an expression without alternatives (no unions): tags, text slots,
``(...)+`` and ``(...)?``. With it goes what was seen in each slot over all pages, and
from both follows which slots hold the article.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecare.llm.buckets import grouped
from tablecare.llm.tables import Scratch
from tablecare.session import configure

SLOT = "#"
#: wrappers of one host that are aligned by one task
_ALIGNED = 200
#: elements nested deeper share the path of this many
_DEPTH = 400
#: the longest group that ``fold`` finds, in items
_GROUP = 12
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)", re.S
)
#: a tag's attributes; a quote counts after an equals sign only
_REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*'|(?![\"'])))*+")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])([^\s\"'=<>/]++)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")

# HTML's element kinds.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title xmp iframe noembed noframes noscript template".split())
_INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark "
    "nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: a start tag of the value closes an open element of the key
_CLOSED_BY = {
    "p": set(
        "address article aside blockquote center details div dl fieldset figcaption figure footer "
        "form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li td th tr dt dd".split()
    ),
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"},
    "option": {"option", "optgroup"},
    "head": {"body"},
}
_SCOPES = {"table", "ul", "ol", "dl", "td", "th", "div", "article", "section", "body", "html", "main"}

# Elements, roles and words that name what is not the article.
_CHROME = set(
    "head nav footer aside script style noscript template iframe svg select button input "
    "textarea dialog menu object embed canvas audio video datalist title".split()
)
#: chrome, unless they hold the article
_HOLDERS = {"form", "fieldset"}
_CHROME_ROLES = set(
    "navigation banner contentinfo complementary search dialog alert alertdialog menu menubar "
    "toolbar form status".split()
)
_CHROME_WORDS = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner banners "
    "breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies disqus "
    "disclaimer feedback footer gdpr hidden login masthead menu menus modal nav navbar navigation "
    "newsletter notice notices notification overlay pager pagination paywall popup promo "
    "promotion promoted recommended related reply replies respond rss search share sharing "
    "sidebar sidebars signup social sponsor sponsored sponsors subscribe subscription toc "
    "toolbar topbar tags tagcloud warning widget widgets".split()
)
_MAIN_WORDS = set("article content post entry story main body text".split())
#: of those, the words of reader comments
_READER_WORDS = set("comment comments commentlist disqus reply replies respond feedback".split())
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Block:
    """One run of text: its text, the path of its elements, and of those the chrome."""

    __slots__ = ("path", "text", "linked", "chrome", "main")

    def __init__(self, path: tuple[str, ...], text: str, linked: int, chrome: bool, main: int):
        self.path, self.text, self.linked = path, text, linked
        self.chrome, self.main = chrome, main


class _Kind:
    """What an element's name and attributes say of it."""

    __slots__ = ("label", "chrome", "holder", "reader", "main", "strict")

    def __init__(self, name: str):
        self.label = name
        #: surely chrome; chrome unless it holds the article; and for readers' comments
        self.chrome, self.holder, self.reader = name in _CHROME, name in _HOLDERS, False
        #: does it name the article, and by more than a word of a class
        self.main = self.strict = name in ("article", "main")


def _element(name: str, attributes: str) -> _Kind:
    """A class or id that is a chrome word (``sidebar``) makes an element chrome. One
    that only contains such a word (``has-sidebar``, ``site-footer``), or stands
    beside a class of article words (``post comments``), leaves it open."""
    kind = _Kind(name)
    if not attributes:
        return kind
    found = {
        k.lower(): entities.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(attributes)
    }
    classes = " ".join(found.get(k, "") for k in ("class", "id")).split()
    parts = [{w.lower() for w in _WORDS.findall(c)} for c in classes]
    words = set().union(*parts)
    if name not in ("html", "body", "article", "main") and words & _CHROME_WORDS:
        named = any(p and p <= _MAIN_WORDS for p in parts)
        kind.holder = True
        kind.chrome |= not named and any(len(p) == 1 and p <= _CHROME_WORDS for p in parts)
        kind.reader = not named and bool(words & _READER_WORDS)
    role = found.get("role", "").lower()
    kind.chrome |= role in _CHROME_ROLES or found.get("aria-hidden", "").lower() == "true"
    style = found.get("style", "").replace(" ", "").lower()
    kind.chrome |= "display:none" in style or bool(
        re.search(r"(?:^|\s)hidden(?:\s|=|$)", _QUOTED.sub("''", attributes))
    )
    kind.strict |= role in ("main", "article") or found.get("itemprop", "") == "articleBody"
    kind.main = kind.strict
    kind.main |= not kind.chrome and name in ("div", "section") and bool(words & _MAIN_WORDS)
    if classes and name not in ("html", "body"):
        shown = {re.sub("[0-9]+", "0", c).replace("/", "|") for c in classes}
        kind.label = f"{name}.{'.'.join(sorted(shown))}"
    return kind


class _Frame:
    """An open element, with what holds for all that is open down to it."""

    __slots__ = ("name", "label", "path", "chrome", "main", "holder", "mark")

    def __init__(self, name: str, kind: _Kind, above: _Frame | None):
        self.name, self.label = name, kind.label
        self.path = above.path if above else ()
        self.chrome = kind.chrome or above is not None and above.chrome
        self.main = above.main if above else 0
        #: numbers of the innermost holder and of the innermost element that names the article
        self.holder, self.mark = (above.holder, above.mark) if above else (-1, -1)
        if name in _INLINE:
            self.chrome |= kind.holder
            return
        if len(self.path) < _DEPTH:
            self.path = (*self.path, kind.label)
        # a header is the site's unless it stands in the article
        self.chrome |= name == "header" and not self.main
        if kind.main:
            self.main = len(self.path)


class _Holders:
    """Elements that are chrome unless they hold the article of the page.

    The article is the heaviest element that names one and stands in holders, none of
    them for readers' comments, if it outweighs all that stands in no chrome at all (twice
    if a class only names it, four times if something there is named an article). But a
    holder of two blocks or more that outweighs both four times is the article.
    """

    def __init__(self) -> None:
        self.above: list[int] = []
        self.reader: list[bool] = []
        #: of elements that name the article: the one above, their holder, by more than a class
        self.marks: list[tuple[int, int, bool]] = []

    def enter(self, frame: _Frame, kind: _Kind) -> None:
        if kind.holder and not kind.chrome:
            self.above.append(frame.holder)
            self.reader.append(kind.reader or frame.holder >= 0 and self.reader[frame.holder])
            frame.holder = len(self.above) - 1
        if kind.main:
            self.marks.append((frame.mark, frame.holder, kind.strict))
            frame.mark = len(self.marks) - 1

    def of_article(self, blocks: list[tuple[Block, int, int]]) -> set[int]:
        """The holders of the article, from blocks in no sure chrome with their
        innermost holder and naming element."""
        if all(holder < 0 for _, holder, _ in blocks):
            return set()
        outside = marked = 0
        held = [0] * len(self.marks)
        loose: Counter[int] = Counter()
        members: Counter[int] = Counter()
        for block, holder, mark in blocks:
            worth = len(block.text) - 3 * block.linked
            if holder < 0:
                outside += max(worth, 0)
                marked += max(worth, 0) * (mark >= 0)
                continue
            loose[holder] += worth
            members[holder] += 1
            if mark >= 0 and self.marks[mark][1] == holder:
                held[mark] += worth
        for number in range(len(self.marks) - 1, -1, -1):
            above, holder, _ = self.marks[number]
            if above >= 0 and self.marks[above][1] == holder:
                held[above] += held[number]
        found, most = -1, 0
        for number, (_, holder, strict) in enumerate(self.marks):
            if holder < 0 or self.reader[holder]:
                continue
            needed = outside * (4 if marked else 1 if strict else 2)
            if held[number] > max(needed, most):
                found, most = holder, held[number]
        most = 4 * max(outside, most)
        for holder, worth in sorted(loose.items()):
            if not self.reader[holder] and members[holder] > 1 and worth > most:
                found, most = holder, worth
        chosen: set[int] = set()
        while found >= 0:
            chosen.add(found)
            found = self.above[found]
        return chosen


def _attributes_end(page: str, at: int) -> tuple[int, int]:
    """Where the attributes of a tag end, and where the tag does. One whose quote is never
    closed ends at the next ``>``, or else with the page."""
    end = _REST.match(page, at).end()
    if end < len(page) and page[end] != ">":
        close = page.find(">", end)
        return end, close + 1 if close >= 0 else len(page)
    return end, min(end + 1, len(page))


def read_page(page: str | None) -> tuple[list[str], list[Block]]:
    """A page's stream of block tags and slots, and its blocks of text. Takes time in
    proportion to the page, whatever its markup."""
    page = page or ""
    tokens: list[str] = []
    blocks: list[Block] = []
    #: blocks in no sure chrome, their innermost holder and naming element
    doubtful: list[tuple[Block, int, int]] = []
    stack: list[_Frame] = []
    opened: Counter[str] = Counter()
    holders = _Holders()
    parts: list[str] = []
    linked = links = 0

    def close_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                top = stack[-1] if stack else None
                if top is None:
                    blocks.append(Block((), text, linked, False, 0))
                    doubtful.append((blocks[-1], -1, -1))
                else:
                    blocks.append(Block(top.path, text, linked, top.chrome, top.main))
                    if not top.chrome:
                        doubtful.append((blocks[-1], top.holder, top.mark))
                tokens.append(SLOT)
        linked = 0

    def pop_to(at: int) -> None:
        nonlocal links
        while len(stack) > at:
            frame = stack.pop()
            opened[frame.name] -= 1
            if frame.name == "a":
                links -= 1
            if frame.name not in _INLINE:
                tokens.append("/" + frame.label)

    def text_of(raw: str) -> None:
        nonlocal linked
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len(text)

    at, end = 0, len(page)
    last = page.rfind(">")
    while at < end:
        found = _TOKEN.search(page, at)
        if not found or found[2] and found.start() > last:
            text_of(page[at:])
            break
        text_of(page[at : found.start()])
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        stop, after = _attributes_end(page, at)
        attributes, at = page[at:stop], after
        if found[1]:
            if name == "br":
                parts.append(" ")
                continue
            if not opened[name]:
                continue
            place = len(stack) - 1
            while stack[place].name != name and (name not in _INLINE or stack[place].name in _INLINE):
                place -= 1
            if name not in _INLINE:
                close_block()
                pop_to(place)
            elif stack[place].name == name:
                pop_to(place)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in _RAW:
            closing = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = closing.end() if closing else end
            if name not in _INLINE:
                tokens.append(name)
            continue
        kind = _element(name, attributes)
        if name not in _INLINE:
            close_block()
            for i in range(len(stack) - 1, -1, -1):
                if name in _CLOSED_BY.get(stack[i].name, ()):
                    pop_to(i)
                    break
                if stack[i].name in _SCOPES:
                    break
            # formatting left open ends with its block
            while stack and stack[-1].name in _INLINE:
                pop_to(len(stack) - 1)
            tokens.append(kind.label)
        if name in _VOID or attributes.endswith("/") and name not in _INLINE:
            continue
        frame = _Frame(name, kind, stack[-1] if stack else None)
        if name not in _INLINE:
            holders.enter(frame, kind)
        stack.append(frame)
        opened[name] += 1
        if name == "a":
            links += 1
    close_block()
    pop_to(0)
    chosen = holders.of_article(doubtful)
    for block, holder, _ in doubtful:
        block.chrome = holder >= 0 and holder not in chosen
    return tokens, blocks


# --- union-free expressions -------------------------------------------------------
# An expression is a list of tags, SLOT, ["+", items] and ["?", items].


def fold(items: list) -> list:
    """Repeats that follow each other become groups, the shortest first."""
    for width in range(1, _GROUP + 1):
        out: list = []
        at = 0
        while at < len(items):
            n = 1
            if at + width < len(items) and items[at] == items[at + width]:
                unit = items[at : at + width]
                if items[at + width : at + 2 * width] == unit and _balanced(unit):
                    n = 2
                    while items[at + n * width : at + (n + 1) * width] == unit:
                        n += 1
            if n > 1:
                inner = unit[0][1] if width == 1 and unit[0][0] == "+" else unit
                out.append(["+", inner])
                at += n * width
            else:
                out.append(items[at])
                at += 1
        items = out
    return items


def _balanced(unit: list) -> bool:
    depth = 0
    for item in unit:
        if isinstance(item, str) and item != SLOT:
            depth += -1 if item[0] == "/" else 1
            if depth < 0:
                return False
    return depth == 0


def _key(item: object) -> str:
    return item if isinstance(item, str) else json.dumps(item)


def _bare(item: object) -> object:
    """Without an option around it."""
    return item[1] if isinstance(item, list) and item[0] == "?" else [item]


def _coded(*sides: Iterable[str]) -> list[str]:
    """Each list of keys as a string of one character a key."""
    codes: dict[str, str] = {}
    return ["".join(codes.setdefault(k, chr(1 + len(codes) % 0x10FFFF)) for k in side) for side in sides]


def _anchors(a: str, b: str) -> list[tuple[int, int]]:
    """Places of equal items in both, rising in both: first those in longer stretches
    that each side has once, then what surrounds them, and between them those in
    shorter ones. Takes time in proportion to the lengths."""
    pairs: list[tuple[int, int]] = []

    def grow(i: int, j: int, k: int, m: int) -> tuple[int, int]:
        """Equal items from the start of both ranges."""
        while i < j and k < m and a[i] == b[k]:
            pairs.append((i, k))
            i, k = i + 1, k + 1
        return i, k

    def gap(i: int, j: int, k: int, m: int, width: int) -> None:
        i, k = grow(i, j, k, m)
        ends = []
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            ends.append((j, m))
        while i < j and k < m and width:
            at = _once(a, i, j, k, m, b, width)
            if at:
                for x, y in at:
                    if x >= i and y >= k:
                        gap(i, x, k, y, width // 2)
                        i, k = grow(x, j, y, m)
                gap(i, j, k, m, width // 2)
                break
            width //= 2
        pairs.extend(ends)

    gap(0, len(a), 0, len(b), 16)
    return sorted(pairs)


def _once(a: str, i: int, j: int, k: int, m: int, b: str, width: int) -> list[tuple[int, int]]:
    """Stretches of so many items that each range has exactly once, in the longest
    order that rises in both."""
    left = Counter(a[x : x + width] for x in range(i, j - width + 1))
    right = Counter(b[y : y + width] for y in range(k, m - width + 1))
    places = {
        b[y : y + width]: y for y in range(k, m - width + 1) if right[b[y : y + width]] == 1
    }
    both = [
        (x, places[a[x : x + width]])
        for x in range(i, j - width + 1)
        if left[a[x : x + width]] == 1 and a[x : x + width] in places
    ]
    tails: list[int] = []
    ending: list[int] = []
    before: list[int] = []
    for number, (_, y) in enumerate(both):
        at = bisect_left(tails, y)
        tails[at : at + 1] = [y]
        ending[at : at + 1] = [number]
        before.append(ending[at - 1] if at else -1)
    rising: list[tuple[int, int]] = []
    number = ending[-1] if ending else -1
    while number >= 0:
        rising.append(both[number])
        number = before[number]
    return rising[::-1]


def align(left: list, right: list) -> list:
    """The expression that covers what both cover."""
    if left == right:
        return left
    left_optional = [isinstance(i, list) and i[0] == "?" for i in left]
    right_optional = [isinstance(i, list) and i[0] == "?" for i in right]
    a, b = _coded((_key(_bare(i)) for i in left), (_key(_bare(i)) for i in right))
    out: list = []
    i = k = 0
    for x, y in [*_anchors(a, b), (len(left), len(right))]:
        out += _resolve(left[i:x], right[k:y])
        if x < len(left):
            optional = left_optional[x] or right_optional[y]
            out.append(["?", _bare(left[x])] if optional else left[x])
        i, k = x + 1, y + 1
    return out


def _resolve(left: list, right: list, again: bool = True) -> list:
    """A mismatch: groups on one side that the other has once, or else options."""
    for groups, plain in ((left, right), (right, left)):
        parts = _with_groups(groups, plain)
        if len(parts) > 1:
            out: list = []
            for before, other, item in parts:
                # what lies between may hold groups of the other side
                out += _resolve(before, other, False) if again else _options(before, other)
                out += item
            return out
    return _options(left, right)


def _with_groups(groups: list, plain: list) -> list[tuple[list, list, list]]:
    """Groups of one side that the other has unrepeated, in order, each with what
    lies before it on both sides; last what follows them."""
    inner = [(at, g) for at, g in enumerate(groups) if isinstance(g, list) and g[0] == "+"]
    parts = []
    start = cursor = 0
    if inner and plain:
        text, *coded = _coded(map(_key, plain), *(map(_key, g[1]) for _, g in inner))
        for (at, group), code in zip(inner, coded, strict=True):
            place = text.find(code, cursor)
            if place >= 0 and plain[place : place + len(code)] == group[1]:
                parts.append((groups[start:at], plain[cursor:place], [group]))
                start, cursor = at + 1, place + len(code)
    return [*parts, (groups[start:], plain[cursor:], [])]


def _options(left: list, right: list) -> list:
    return [
        item if isinstance(item, list) and item[0] == "?" else ["?", [item]]
        for item in [*left, *right]
    ]


def infer(expressions: list[list]) -> list:
    """Align expressions one after the other."""
    wrapper = expressions[0]
    for expression in expressions[1:]:
        wrapper = align(wrapper, expression)
    return wrapper


def slots(wrapper: list) -> dict[str, str]:
    """The kind of each slot by its path of elements: ``once``, ``option`` or ``repeat``
    (several slots of one path are repeated)."""
    found: dict[str, str] = {}

    def walk(items: list, path: list[str], kind: str) -> None:
        for item in items:
            if isinstance(item, list):
                inner = "repeat" if item[0] == "+" or kind == "repeat" else "option"
                walk(item[1], path, inner)
            elif item == SLOT:
                name = "/".join(path)
                found[name] = kind if name not in found else "repeat"
            elif item[0] == "/":
                if item[1:] in path:
                    del path[len(path) - 1 - path[::-1].index(item[1:]) :]
            elif item.split(".")[0] not in _VOID | _RAW:
                path.append(item)

    walk(wrapper, [], "once")
    return found


def article(blocks: list[Block], region: str) -> str:
    """The text of the blocks in the region, or where the page has none of it, in
    the page's own named or else heaviest part."""
    use = [b for b in blocks if not b.chrome]
    prefix = region.split("/") if region else []
    inside = [b for b in use if prefix and list(b.path[: len(prefix)]) == prefix]
    if not inside:
        own = _own_region(use)
        inside = [b for b in use if list(b.path[: len(own)]) == own]
    return "\n".join(b.text for b in inside)


def _own_region(blocks: list[Block]) -> list[str]:
    weight: dict[tuple, int] = {}
    for block in blocks:
        at = block.path[: block.main] if block.main else block.path[:-1]
        bonus = 4 if block.main else 1
        weight[at] = weight.get(at, 0) + bonus * (len(block.text) - 3 * block.linked)
    best = max(weight, key=lambda at: (weight[at], at), default=())
    return list(best)


# --- on Spark ---------------------------------------------------------------------


def host(url: Column) -> Column:
    """The host of a URL in lower case; empty if there is none."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.coalesce(found, F.lit(""))


def infer_wrappers(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """``host``, ``wrapper`` (JSON) and ``region`` of every host.

    Pages with one expression are counted in the tasks before anything is shuffled,
    so that the hot host sends what it has of different ones. They are aligned in
    groups of bounded size, and the results again until each host has one.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            streams: dict[tuple[str, str], int] = {}
            seen: dict[tuple, list[int]] = {}
            for of, page in zip(batch["host"], batch["html"], strict=True):
                tokens, blocks = read_page(page)
                key = (of, json.dumps(fold(tokens)))
                streams[key] = streams.get(key, 0) + 1
                for block in blocks:
                    place = (of, "/".join(block.path), block.chrome, block.main)
                    sums = seen.setdefault(place, [0, 0])
                    sums[0] += len(block.text)
                    sums[1] += block.linked
            rows = [(h, e, None, None, n, 0, 0) for (h, e), n in streams.items()]
            rows += [(h, p, c, m, 0, *sums) for (h, p, c, m), sums in seen.items()]
            yield pd.DataFrame(rows, columns=["host", "what", "chrome", "main", "pages", "chars", "linked"])

    schema = "host string, what string, chrome boolean, main int, pages long, chars long, linked long"
    found = pages.mapInPandas(read, schema).groupBy("host", "what", "chrome", "main")
    found = scratch.keep(found.agg(*(F.sum(c).alias(c) for c in ("pages", "chars", "linked"))))

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        # in an order that does not depend on the partitions
        expressions = [json.loads(e) for e in sorted(rows["what"], key=lambda e: (len(e), e))]
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "what": [json.dumps(infer(expressions))]})

    wrappers = found.where("main is null").select("host", "what")
    groups = 2
    while groups > 1:
        counts = wrappers.groupBy("host").agg(F.ceil(F.count("*") / _ALIGNED).alias("groups"))
        groups = counts.agg(F.max("groups")).first()[0] or 0
        dealt = wrappers.join(counts, "host").withColumn("group", F.pmod(F.xxhash64("what"), "groups"))
        wrappers = scratch.keep(grouped(dealt, ["host", "group"], merge, "host string, what string"))
    regions = _regions(wrappers, found.where("main is not null and not chrome"))
    return wrappers.withColumnRenamed("what", "wrapper").join(regions, "host", "left")


def _regions(wrappers: DataFrame, seen: DataFrame) -> DataFrame:
    """``host`` and ``region``, the path below which its article lies: the heaviest
    element that names one, or else the heaviest parent of texts, ties to the
    smaller path. Links weigh against it, and a slot that is no part of a repeated group
    counts half, as articles seldom are one text. All entries of a path count."""

    def kinds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (of, path, kind)
                for of, wrapper in zip(batch["host"], batch["what"], strict=True)
                for path, kind in slots(json.loads(wrapper)).items()
            ]
            yield pd.DataFrame(rows, columns=["host", "what", "kind"])

    kind = wrappers.mapInPandas(kinds, "host string, what string, kind string")
    worth = (F.col("chars") - 3 * F.col("linked")) * F.when(
        F.coalesce("kind", F.lit("repeat")) == "repeat", 1.0
    ).otherwise(0.5)
    path = F.split("what", "/")

    def region(depth: Column, unnamed: bool) -> Column:
        part = F.array_join(F.slice(path, F.lit(1), depth), "/")
        return F.struct(F.lit(unnamed).alias("unnamed"), part.alias("region"))

    places = F.array(
        F.when(F.col("main") > 0, region(F.col("main"), False)), region(F.size(path) - 1, True)
    )
    weighed = seen.join(kind, ["host", "what"], "left").select(
        "host", worth.alias("worth"), F.explode(places).alias("at")
    )
    total = weighed.where("at is not null").groupBy("host", "at").agg(F.sum("worth").alias("worth"))
    best = F.min(F.struct("at.unnamed", -F.col("worth"), "at.region")).alias("best")
    return total.where("worth > 0").groupBy("host").agg(best).select("host", "best.region")


#: bytes up to which the regions of all hosts are sent to every task
_SMALL = 32 << 20


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` (the article: blocks in page order, joined by a line
    feed, white space made one space) and ``n_chars`` of every row.

    Null and empty pages have an empty text, as have pages without any text but
    menus and the like. Pages without a host in their url share the empty host.
    Repeated rows give repeated rows, an empty table an empty one. Other columns are
    not read.
    """
    spark = configure(pages.sparkSession)
    result, scratch = Scratch(spark, "wrappers"), Scratch(spark, "wrappers-work")
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    regions = result.keep(infer_wrappers(rows.select("host", "html"), scratch).select("host", "region"))
    scratch.drop()
    size = regions.agg(F.sum(F.length("host") + F.length("region") + 64)).first()[0] or 0
    known = F.broadcast(regions) if size <= _SMALL else regions

    @F.pandas_udf("string")
    def extract(page: pd.Series, region: pd.Series) -> pd.Series:
        return pd.Series(
            [article(read_page(p)[1], r or "") for p, r in zip(page, region, strict=True)], dtype=object
        )

    text = extract("html", "region")
    return rows.join(known, "host", "left").select("page_id", "url", text.alias("text")).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars")
    )
