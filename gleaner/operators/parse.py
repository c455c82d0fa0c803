"""Any HTML to raw blocks, with depth, ancestors and class weights.

The parser keeps a stack of open elements, which no SQL window can: it runs as a
Python map over batches of pages, where the pages are, and sends back a row per
block start. What spans several blocks is left to windows.

Recovery: missing html, head and body are supplied; a block-level start tag ends
an open head, or a paragraph if that is innermost, but no formatting element; an
end tag closes what is open inside its element, unless something of higher rank
is, and is ignored if nothing matches.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import tags

_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "xmp", "iframe", "noembed", "noframes", "textarea", "title")}
_TOKEN = re.compile(r"[^ \t\n\r\f\x0b]+")
_GOOD, _BAD = re.compile(tags.GOOD_WORDS, re.I), re.compile(tags.BAD_WORDS, re.I)
_IGNORED, _STARTS, _VOID = frozenset(tags.IGNORED), frozenset(tags.BLOCK_STARTS), frozenset(tags.VOID)
_HEAD = frozenset(("script", "style", "meta", "link", "title", "base"))
_BLANK = " \t\n\r\f\x0b"

SCHEMA = (
    "raw_block int, start_tag string, text string, link_text string, css_id string, css_class string, n_tags int, n_anchors int, "
    "ancestors array<long>, weights array<struct<node_id: long, weight: int>>, hrefs array<string>, depth_start int, depth_tag int, depth_low int"
)


def nested(html: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(kind, tag or text, attributes) in order, every open with its close."""
    stack: list[str] = []
    heads = bodies = 0
    held: list[str] = []
    at = 0

    def texts() -> Iterator[tuple[str, str, dict[str, str]]]:
        whole = "".join(held)
        held.clear()
        if whole:
            yield "text", entities.unescape(whole) if "&" in whole else whole, {}

    def opened(tag: str, attributes: dict[str, str]) -> tuple[str, str, dict[str, str]]:
        stack.append(tag)
        return "open", tag, attributes

    def implied(tag: str) -> Iterator[tuple[str, str, dict[str, str]]]:
        nonlocal heads, bodies
        if tag == "html":
            return
        if not stack:
            yield opened("html", {})
        if tag in ("head", "body"):
            return
        if len(stack) == 1 and tag in _HEAD and not heads and not bodies:
            heads += 1
            yield opened("head", {})
        elif tag not in _HEAD and "body" not in stack and "head" not in stack and tag not in ("frameset", "frame", "noframes"):
            bodies += 1
            yield opened("body", {})

    while at < len(html):
        m = _PIECE.match(html, at)
        at = m.end()
        name = m[2]
        if name is None:
            piece = m[0]
            if piece.startswith(("<!", "<?")):
                continue
            if not held and stack[-1:] in ([], ["html"], ["head"]):
                if not piece.strip(_BLANK):
                    continue
                while stack and stack[-1] == "head":
                    yield "close", stack.pop(), {}
                yield from implied("p")
                if bodies <= 1 and stack[-1] == "body":
                    yield opened("p", {})
            held.append(piece)
            continue
        tag = name.lower()
        yield from texts()
        if m[1]:
            rank = tags.RANK.get(tag, 100)
            for k in range(len(stack) - 1, -1, -1):
                if stack[k] == tag:
                    if tag not in ("body", "html"):  # they end with the page
                        while len(stack) > k:
                            yield "close", stack.pop(), {}
                    break
                if tags.RANK.get(stack[k], 100) > rank:
                    break
            continue
        attributes = {}
        for a, x, y, z in _ATTRIBUTE.findall(m[3]):
            attributes.setdefault(a.lower(), entities.unescape(x or y or z))
        if tag in ("html", "body", "head") and tag in stack:
            continue
        while stack:
            top = stack[-1]
            if (top in ("p", "head") and tag in tags.BLOCK_LEVEL) or top in tags.ENDS.get(tag, ()) or (top == "head" and tag not in _HEAD and tag not in ("head", "noscript", "template")):
                yield "close", stack.pop(), {}
            else:
                break
        yield from implied(tag)
        heads += tag == "head"
        bodies += tag == "body"
        yield opened(tag, attributes)
        if tag in _VOID:
            yield "close", stack.pop(), {}
        elif tag in _RAW:
            end = _RAW[tag].search(html, at)
            body = html[at : end.start() if end else len(html)]
            if body:
                yield "text", entities.unescape(body) if tag in ("title", "textarea") else body, {}
            at = end.end() if end else len(html)
            yield "close", stack.pop(), {}
    yield from texts()
    while stack:
        yield "close", stack.pop(), {}


def weight_of(tag: str, attributes: dict[str, str]) -> int:
    """Points of an element by its id, class and tag."""
    total = tags.TAG_WEIGHTS.get(tag, 0)
    for a in ("id", "class"):
        if a in attributes:
            total += 25 * bool(_GOOD.search(attributes[a])) - 25 * bool(_BAD.search(attributes[a]))
    return total


class _Raw:
    """What belongs to one block start."""

    def __init__(self, tag: str, depth: int, ancestors: list[int]):
        self.tag, self.depth, self.ancestors = tag, depth, ancestors
        self.words: list[str] = []
        self.links: list[str] = []
        self.ids: list[str] = []
        self.classes: list[str] = []
        self.hrefs: list[str] = []
        self.weights: list[tuple[int, int]] = []
        self.tags = self.anchors = 0
        self.low: int | None = None
        self.low_at_tag: int | None = None

    def level(self, depth: int) -> None:
        self.low = depth if self.low is None else min(self.low, depth)

    def row(self, number: int) -> tuple:
        squeezed = lambda values: " ".join(t for v in values for t in _TOKEN.findall(v)).lower()
        return (number, self.tag, " ".join(self.words), " ".join(self.links), squeezed(self.ids), squeezed(self.classes), self.tags, self.anchors, self.ancestors, self.weights, self.hrefs, self.depth, self.low_at_tag, self.low)


def raw_rows(html: str | None) -> list[tuple]:
    """The raw blocks of a page as tuples in the order of SCHEMA."""
    return list(each_raw_row(html))


def each_raw_row(html: str | None) -> Iterator[tuple]:
    """``raw_rows``, each as soon as the next block starts."""
    if not html or not can_parse(html):
        return
    now, block = _Raw("", 0, []), 0
    numbers: list[int] = []  # node numbers of the elements entered
    parents = [False]  # whether the element entered has had a child
    counter = 0
    skipped = anchored = depth = 0
    for kind, value, attributes in nested(html):
        if kind == "text":
            if not skipped and numbers and (len(numbers) > 1 or parents[-1] or anchored):
                words = _TOKEN.findall(value)
                now.words += words
                if anchored:
                    now.links += words
            continue
        if kind == "close":
            if skipped:
                skipped -= 1
            elif anchored:
                anchored -= 1
            else:
                depth -= 1
                now.level(depth)
                numbers.pop()
                parents.pop()
            continue
        if skipped:
            skipped += 1
            continue
        if not numbers:
            number = 0
        else:
            if not anchored:
                if not parents[-1]:
                    parents[-1] = True
                    counter += 1
                counter += 1
                number = counter
            now.tags += 1
            now.anchors += value == "a"
            starts = value in _STARTS
            if not starts:
                # the lowest level so far counts up to here
                now.low_at_tag = now.depth if now.low is None else now.low
            if value in _IGNORED:
                skipped = 1
                continue
            if anchored:
                anchored += 1
                continue
            if starts:
                now.tags -= 1
                yield now.row(block)
                now, block = _Raw(value, depth, list(numbers)), block + 1
            if "id" in attributes:
                now.ids.append(attributes["id"])
            if "class" in attributes:
                now.classes.append(attributes["class"])
            if value == "a":
                now.hrefs.append(attributes.get("href", ""))
                anchored = 1
                continue
        depth += 1
        now.level(depth)
        numbers.append(number)
        parents.append(False)
        now.weights.append((number, weight_of(value, attributes)))
    yield now.row(block)


_COMMENT = r"(?s)<!--.*?(?:-->|\z)"


def can_parse(html: str) -> bool:
    return bool(re.sub(r"<!--.*?(?:-->|\Z)", "", html, flags=re.S).strip())


def parseable(html: Column) -> Column:
    """Whether a page has anything but comments and white space."""
    return F.coalesce(F.trim(F.regexp_replace(html, _COMMENT, "")) != "", F.lit(False))


#: Rows, and characters and numbers in them, that are held as Python objects at a time.
PIECE_ROWS, PIECE_SIZE = 2_000, 1 << 22


def _table(keys: list[str], rows: list[tuple]) -> pa.RecordBatch:
    number, tag, text, link, ids, classes, n_tags, n_anchors, ancestors, weights, hrefs, start, at_tag, low = zip(*rows)

    def listed(lists: tuple[list, ...], make) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(list(accumulate(map(len, lists), initial=0)), pa.int32()), make(list(chain.from_iterable(lists))))

    def pairs(flat: list[tuple[int, int]]) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array([n for n, _ in flat], pa.int64()), pa.array([w for _, w in flat], pa.int32())], ["node_id", "weight"])

    text_of, int_of = (lambda x: pa.array(x, pa.string())), (lambda x: pa.array(x, pa.int32()))
    lists = [listed(ancestors, lambda x: pa.array(x, pa.int64())), listed(weights, pairs), listed(hrefs, text_of)]
    columns = [text_of(keys), int_of(number), *map(text_of, (tag, text, link, ids, classes)), *map(int_of, (n_tags, n_anchors)), *lists, *map(int_of, (start, at_tag, low))]
    return pa.RecordBatch.from_arrays(columns, ["key", *(c.split()[0] for c in re.split(r", (?=\w+ )", SCHEMA))])


def _in_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The raw blocks of batches of (key, html)."""
    keys, rows, held = [], [], 0
    for b in batches:
        for k, page in zip(b.column(0), b.column(1)):
            k = k.as_py()
            for r in each_raw_row(page.as_py()):
                keys.append(k)
                rows.append(r)
                held += sum(len(x) for x in r if isinstance(x, (str, list)))
                if len(rows) >= PIECE_ROWS or held >= PIECE_SIZE:
                    yield _table(keys, rows)
                    keys, rows, held = [], [], 0
    if rows:
        yield _table(keys, rows)


def raw_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, columns of SCHEMA), one row per block start of every page.

    Rows leave Python in pieces, however many pages a batch has.
    """
    kind = pages.schema[key].dataType.simpleString()

    source = pages.select(F.col(key).cast("string").alias("key"), F.col(html).cast("string").alias("html")).filter("html IS NOT NULL")
    made = source.mapInArrow(_in_pieces, f"key string, {SCHEMA}")
    return made.select(F.col("key").cast(kind).alias(key), *made.columns[1:])
