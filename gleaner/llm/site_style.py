"""HTML extraction by site style trees.

The DOMs of a host's pages are merged into one tree. An element node is a path of
tags with their presentation (class, id, role); under it are the style nodes, the
sequences of children seen there, and the text found there. The importance of an
element is the entropy, to the base of the number of pages m, of its style nodes
(how many ways it is presented) combined with the importance of what is below it;
that of text is one minus the mean entropy of its runs over the pages: a run on
every page tells nothing, one on a single page everything. To the base of few pages
that falls fast, so text counts as fully important unless its runs are on more than
two pages in the geometric mean, or all on both of two. Branches in which no
node reaches ``threshold`` are removed from each page, the rest is its content.

Counting runs over (host, path, style) and (host, path, run) rows, and what a path's
styles and runs come to is summed up before a host's tree is put together: a task
holds the host's distinct paths and which follow which, not its styles, runs or
pages. Pages meet the
lists of unimportant paths by a join: the lists are broadcast while their size,
which is checked, is within ``BROADCAST_BYTES``; beyond, both sides are exchanged
by host, split by adaptive execution where one host dominates.

Defined results
---------------
* One row per page row: page_id, host, text (kept runs, a line each), runs,
  removed. Scripts, styles, comments and the head's metadata are no content.
* A null or empty html gives an empty text. A page without a host, or alone on
  it, keeps everything. Rows without a page_id are pages too. Rows of equal html on
  a host count as one page of it, so copies of a page don't make it boilerplate.
* Broken HTML is read as far as it goes: an open ``p`` or ``li`` ends at the next
  block, an end tag closes what is open inside, one without start is ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.shared import checkpointed, read_table

THRESHOLD = 0.75
DECAY = 0.9
#: Hosts whose lists a task keeps ready.
KNOWN_HOSTS = 1000
BROADCAST_BYTES = 64 << 20
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|([^<]+|<)", re.S | re.I)
_STYLE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code em font i mark q s small span strike strong sub sup tt u br img wbr".split())
_BLOCK = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table ul dd dt td th tr tbody thead".split())


def number(*parts: object) -> int:
    """A signed 64-bit hash."""
    return int.from_bytes(blake2b("\x1f".join(map(str, parts)).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def parse(html: str | None) -> list[tuple[int, int, int, str | None]]:
    """Nodes (own path, parent's path, parent's node, run) in order; run is None for elements.

    Inline elements are part of the run around them.
    """
    root = number("")
    nodes: list[tuple[int, int, int, str | None]] = [(root, 0, -1, None)]
    stack: list[tuple[str, int, int]] = [("", root, 0)]
    run: list[str] = []

    def flush() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            _, path, node = stack[-1]
            nodes.append((number(path, "#text"), path, node, entities.unescape(text) if "&" in text else text))

    for m in _TOKEN.finditer(html or ""):
        if m[5] is not None:
            run.append(m[5])
            continue
        if m[3] is None:
            continue
        tag = m[3].lower()
        if tag in _INLINE:
            if tag == "br":
                run.append(" ")
            continue
        flush()
        if m[2]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag in _BLOCK:
            while len(stack) > 1 and (stack[-1][0] == "p" or (tag == "li" and stack[-1][0] == "li")):
                stack.pop()
        style = " ".join(sorted(f"{a.lower()}={(x or y or z).strip().lower()}" for a, x, y, z in _STYLE.findall(m[4]))) if m[4] else ""
        _, above, parent = stack[-1]
        path = number(above, tag, style)
        nodes.append((path, above, parent, None))
        if tag not in _VOID and not m[4].endswith("/"):
            stack.append((tag, path, len(nodes) - 1))
    flush()
    return nodes


def observations(nodes: list[tuple[int, int, int, str | None]]) -> list[tuple[int, int, int, list[int]]]:
    """What one page adds to the tree: (path, kind, value, children), each once.

    kind 0: the path is there; 1: a style node under it; 2: a run at it.
    """
    children: dict[int, list[int]] = defaultdict(list)
    seen: dict[tuple[int, int, int], list[int]] = {}
    for path, _, parent, run in nodes:
        seen[path, 0, 0] = []
        if parent >= 0 and (not children[parent] or children[parent][-1] != path):
            children[parent].append(path)  # repeated children count once: lists of any length are one style
        if run is not None:
            seen[path, 2, number(run)] = []
    for i, (path, _, _, run) in enumerate(nodes):
        if run is None and children[i]:
            seen[path, 1, number(*children[i])] = children[i]
    return [(p, k, v, c) for (p, k, v), c in seen.items()]


class Shown(NamedTuple):
    """What a path's style nodes come to."""

    #: how many there are; their entropy
    styles: int
    entropy: float
    #: child -> its share of the lists of children, weighted by pages
    below: dict[int, float]


def unimportant(pages: dict[int, int], runs: dict[int, float], shown: dict[int, Shown], threshold: float, decay: float = DECAY) -> list[int]:
    """Paths of a host in whose branch nothing is important.

    pages: pages per path; runs: importance of a path's text; shown: per path with children.
    """
    value: dict[int, float] = {}
    best: dict[int, float] = {}
    nothing = Shown(0, 0.0, {})
    todo = [(number(""), False)]
    while todo:
        path, ready = todo.pop()
        if path in value and not ready:
            continue
        styles, entropy, below = shown.get(path, nothing)
        if not ready:
            value[path] = best[path] = 0.0
            todo.append((path, True))
            todo += [(c, False) for c in below if c not in value]
            continue
        m = pages.get(path, 1)
        if path in runs:
            value[path] = best[path] = runs[path]
            continue
        own = 1.0 if m <= 1 else entropy / np.log(m)
        weight = decay**styles
        value[path] = (1 - weight) * own + weight * sum(value[c] * share for c, share in below.items())
        best[path] = max([value[path] if m > 1 or not below else 0.0, *(best[c] for c in below)])
    return [p for p, b in best.items() if b < threshold]


def text_importance(mean: float, m: int) -> float:
    """Of a path on m pages; mean: of the logarithm of the pages of its runs.

    Text that is hardly repeated is no boilerplate; from 17 pages on, nothing that THRESHOLD cuts is.
    """
    if m <= 1 or mean < np.log(2) - 1e-9 or (m > 2 and mean < np.log(2) + 1e-9):
        return 1.0
    return 1.0 - mean / np.log(m)


def host_of(url):
    return F.nullif(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def noise(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """host, noise: the paths that each host's pages do without."""

    def observe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(host, *o, share) for host, html, share in zip(b["host"], b["html"], b["share"]) for o in observations(parse(html))]
            yield pd.DataFrame(out, columns=["host", "path", "kind", "value", "children", "share"])

    source = pages.select(host_of(F.col("url")).alias("host"), "html").filter("host IS NOT NULL AND html IS NOT NULL")
    source = source.withColumn("page", F.unhex(F.sha2("html", 256)))
    copied = checkpointed(source.groupBy("host", "page").agg(F.count("*").alias("copies")).filter("copies > 1"))
    listed = copied.agg(F.sum(F.length("host") + 64)).first()[0] or 0
    source = source.join(F.broadcast(copied) if listed <= BROADCAST_BYTES else copied, ["host", "page"], "left")
    # each of k copies is a k-th of a page
    source = source.select("host", "html", (1 / F.coalesce("copies", F.lit(1))).alias("share"))
    seen = source.mapInPandas(observe, "host string, path long, kind int, value long, children array<long>, share double")
    # children follow from the value
    counts = seen.groupBy("host", "path", "kind", "value").agg(F.round(F.sum("share")).cast("long").alias("n"), F.max("children").alias("children"))
    counts = checkpointed(counts)
    alone = counts.filter("kind = 2").groupBy("host", "path").agg(F.avg(F.log("n")).alias("mean"))
    there = counts.filter("kind = 0").select("host", "path", F.col("n").alias("m"))
    styles = counts.filter("kind = 1")
    # entropy: log of the total less the mean of the logs
    shown = styles.groupBy("host", "path").agg(F.count("*").alias("styles"), F.sum("n").alias("total"), F.sum(F.col("n") * F.log("n")).alias("logs"))
    edges = styles.select("host", "path", (F.col("n") / F.size("children")).alias("part"), F.explode("children").alias("child")).groupBy("host", "path", "child").agg(F.sum("part").alias("part"))
    below = edges.groupBy("host", "path").agg(F.collect_list(F.struct("child", "part")).alias("below"))
    tree = there.join(alone, ["host", "path"], "left").join(shown, ["host", "path"], "left").join(below, ["host", "path"], "left")

    def judge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pages_, runs, shown_ = {}, {}, {}
        for path, m, mean, count, total, logs, kids in zip(*(pdf[c] for c in ("path", "m", "mean", "styles", "total", "logs", "below"))):
            pages_[path] = m
            if not pd.isna(mean):
                runs[path] = text_importance(mean, m)
            if kids is not None:
                shown_[path] = Shown(int(count), max(0.0, np.log(total) - logs / total), {c: s / total for c, s in sorted((k["child"], k["part"]) for k in kids)})
        return pd.DataFrame({"host": [key[0]], "noise": [sorted(unimportant(pages_, runs, shown_, threshold))]})

    return tree.groupBy("host").applyInPandas(judge, "host string, noise array<long>")


def extract(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, text, runs, removed of every page."""
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), host_of(F.col("url")).alias("host"), "html")
    gone = checkpointed(noise(pages, threshold))
    listed = gone.agg(F.sum(8 * F.size("noise") + 64)).first()[0] or 0
    joined = rows.join(F.broadcast(gone) if listed <= BROADCAST_BYTES else gone, "host", "left")

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, frozenset] = {}
        for b in batches:
            out = []
            for id_, host, html, paths in zip(b["page_id"], b["host"], b["html"], b["noise"]):
                if host not in known:
                    if len(known) >= KNOWN_HOSTS:
                        known.clear()
                    known[host] = frozenset(paths.tolist()) if paths is not None else frozenset()
                gone, kept, dropped, cut = known[host], [], 0, set()
                for i, (path, _, parent, run) in enumerate(parse(html)):
                    if path in gone or parent in cut:
                        cut.add(i)
                        dropped += run is not None
                    elif run is not None:
                        kept.append(run)
                out.append((id_, host, "\n".join(kept), len(kept), dropped))
            yield pd.DataFrame(out, columns=["page_id", "host", "text", "runs", "removed"]).astype({"runs": "int32", "removed": "int32"})

    made = joined.mapInPandas(apply, "page_id string, host string, text string, runs int, removed int")
    return made.withColumn("page_id", F.col("page_id").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
