"""Numbers per block, as columns beside the block's key.

All features of a page depend on that page's blocks only; windows and aggregates
partition by page, so a table of blocks is exchanged at most once.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions import tags

DENSITY = ("k_prev_ld", "k_prev_td", "k_ld", "k_td", "k_next_ld", "k_next_td")
SMOOTH = ("w_smooth", "w_absdiff")
READABILITY = ("readability",)
CSS = tuple(f"css_{a}_{w}" for a, words in tags.CSS_WORDS.items() for w in words) + ("css_id_ss_again",)
CLUSTERED = ("cw",)


def _page(key: str) -> tuple:
    w = Window.partitionBy(key)
    return w, w.orderBy("block_idx")


def enough_blocks(blocks: DataFrame, key: str = "page_id", least: int = 3) -> DataFrame:
    """Blocks of pages with at least ``least`` blocks."""
    page, _ = _page(key)
    return blocks.withColumn("n_blocks", F.count("*").over(page)).filter(F.col("n_blocks") >= least).drop("n_blocks")


def kohlschuetter(blocks: DataFrame, key: str = "page_id", strict: bool = False) -> DataFrame:
    """Densities of the block before, the block and the block after; 0 beyond the ends.

    Pages of fewer than three blocks get nulls, or raise ValueError if ``strict``.
    """
    page, order = _page(key)
    if strict and blocks.groupBy(key).count().filter("count < 3").limit(1).count():
        raise ValueError("a page has fewer than three blocks")
    many = F.count("*").over(page) >= 3
    near = lambda c, by: F.when(many, F.lag(c, by, 0.0).over(order) if by else F.col(c))
    values = chain.from_iterable((near("link_density", by), near("text_density", by)) for by in (1, 0, -1))
    return blocks.withColumns(dict(zip(DENSITY, values)))


def css(blocks: DataFrame, key: str = "page_id") -> DataFrame:
    """1 where a word is in the block's id or class, else 0; 36 columns."""
    found = {f"css_{a}_{w}": F.contains(F.col(f"css_{a}"), F.lit(w)).cast("int") for a, words in tags.CSS_WORDS.items() for w in words}
    return blocks.withColumns({**found, "css_id_ss_again": F.contains(F.col("css_id"), F.lit("ss")).cast("int")})


def kernel(sigma: float) -> list[tuple[int, float]]:
    """Offsets and weights of a Gaussian cut at four sigmas, summing to 1."""
    radius = int(4 * sigma + 0.5)
    raw = [(o, math.exp(-o * o / (2.0 * sigma * sigma))) for o in range(-radius, radius + 1)]
    total = sum(w for _, w in raw)
    return [(o, w / total) for o, w in raw]


def smoothed(values: Column, sigma: float = 1.0) -> Column:
    """An array of numbers, each replaced by its Gaussian mean; mirrored ends."""
    n = F.size(values)

    def one(_, i: Column) -> Column:
        def at(offset: int) -> Column:
            m = F.pmod(i + F.lit(offset), 2 * n)
            return F.get(values, F.when(m < n, m).otherwise(2 * n - 1 - m))

        total = None
        for o, w in kernel(sigma):
            term = at(o) * F.lit(w)
            total = term if total is None else total + term
        return total

    return F.transform(values, one)


def content_to_tags(blocks: DataFrame) -> Column:
    return F.octet_length("text") / F.greatest(F.col("tagcount"), F.lit(1)).cast("double")


def weninger(blocks: DataFrame, key: str = "page_id", sigma: float = 1.0) -> DataFrame:
    """Smoothed content-to-tag ratio, and smoothed size of its change.

    The change is the mean of the next three ratios (as many as there are) minus
    the own one; at the last block, half the difference to the one before. The
    change on a page of one block is 0.

    The kernel is a weighted sum over the rows within its radius, mirrored at both
    ends of the page; no more of a page than that is held beside a row.
    """
    page, order = _page(key)
    radius = kernel(sigma)[-1][0]
    rows = blocks.withColumn("ctr", content_to_tags(blocks))
    ahead = F.avg("ctr").over(order.rowsBetween(1, 3))
    back = F.coalesce(0.5 * (F.col("ctr") + F.lag("ctr").over(order)), F.col("ctr"))
    rows = rows.withColumn("change", F.abs(F.coalesce(ahead, back) - F.col("ctr")))
    near = order.rowsBetween(-radius, radius)
    rows = rows.withColumns({"near_ctr": F.collect_list("ctr").over(near), "near_change": F.collect_list("change").over(near), "at": F.row_number().over(order) - 1, "n": F.count("*").over(page)})
    first = F.greatest(F.col("at") - F.lit(radius), F.lit(0))

    def mean(values: str) -> Column:
        n = F.col("n").cast("int")
        total = None
        for o, w in kernel(sigma):
            m = F.pmod(F.col("at") + F.lit(o), 2 * n)
            term = F.get(F.col(values), F.when(m < n, m).otherwise(2 * n - 1 - m) - first) * F.lit(w)
            total = term if total is None else total + term
        return total

    return rows.withColumns({SMOOTH[0]: mean("near_ctr"), SMOOTH[1]: mean("near_change")}).drop("ctr", "change", "near_ctr", "near_change", "at", "n")


def readability(blocks: DataFrame, key: str = "page_id") -> DataFrame:
    """Score of the best subtree that a block is in, against the page's best.

    Nodes score by the weight of their tag and class, plus points for each
    paragraph or div right below them by its length, all less the share of link
    text in the subtree. Blocks need ancestors, weights and their start tag.

    A block is taken apart into a row for itself and one for each node that it adds
    to; windows by node, page and block put it together again. The blocks are read
    once, and all of it keeps their partitioning by page.
    """
    size, whole = F.col("n_bytes"), F.struct(*[F.col(f"`{c}`") for c in blocks.columns])
    kind = blocks.select(whole.alias("row")).schema["row"].dataType
    types = {"node": "bigint", "points": "int", "gain": "int", "linked": "double", "bytes": "int", "row": kind}

    def part(**given: Column) -> Column:
        return F.struct(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in types.items()])

    listed = lambda c: F.coalesce(F.col(c), F.array().cast(blocks.schema[c].dataType))
    ancestors = listed("ancestors")
    counts = (size > 25) & F.col("block_start_tag").isin("div", "p") & (F.size(ancestors) > 0)
    gain = 1 + F.least(F.floor(size / 100), F.lit(3))
    parts = F.concat(
        F.array(part(row=whole)),
        F.transform(listed("readability_class_weights"), lambda w: part(node=w["node_id"], points=w["weight"])),
        F.when(counts, F.array(part(node=F.get(ancestors, F.size(ancestors) - 1), gain=gain))).otherwise(F.array().cast(T.ArrayType(blocks.select(part().alias("p")).schema["p"].dataType))),
        F.transform(ancestors, lambda a: part(node=a, linked=F.col("link_density") * size, bytes=size)),
    )
    rows = blocks.select(key, "block_idx", F.explode(parts).alias("part")).select(key, "block_idx", "part.*")
    node = Window.partitionBy(key, "node")
    total = lambda c: F.sum(c).over(node)
    share = F.coalesce(total("linked"), F.lit(0.0)) / F.greatest(F.coalesce(total("bytes"), F.lit(0)), F.lit(1))
    rows = rows.withColumn("score", F.when(F.col("node").isNotNull(), (F.coalesce(total("points"), F.lit(0)) + total("gain")) * (1 - share)))
    best = F.greatest(F.max("score").over(Window.partitionBy(key)), F.lit(1.0))
    rows = rows.withColumn("above", F.when(F.col("bytes").isNotNull(), F.col("score") / best))
    rows = rows.withColumn("readability", F.greatest(F.coalesce(F.max("above").over(Window.partitionBy(key, "block_idx")), F.lit(0.0)), F.lit(0.0)))
    return rows.filter("row IS NOT NULL").select("row.*", "readability")


def kmeans_centers(rows: DataFrame, clusters: int = 3, max_iter: int = 50, tol: float = 0.001, seed: int = 7, n_init: int = 3) -> list[list[float]]:
    """Centres over w_smooth and w_absdiff, each column sorted, the first at 0.

    The best of ``n_init`` starts, by the sum of squared distances.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=list(SMOOTH), outputCol="v").transform(rows.select(*SMOOTH).dropna())
    data = data.select("v").persist()
    found = [KMeans(k=clusters, maxIter=max_iter, tol=tol, seed=seed + i, featuresCol="v").fit(data) for i in range(n_init)]
    centers = min(found, key=lambda m: m.summary.trainingCost).clusterCenters()
    data.unpersist()
    columns = [sorted(float(c[i]) for c in centers) for i in range(2)]
    columns[0][0] = columns[1][0] = 0.0
    return [list(c) for c in zip(*columns)]


def clustered_weninger(blocks: DataFrame, centers: list[list[float]] | None = None, key: str = "page_id", sigma: float = 1.0, **options) -> DataFrame:
    """1 where the nearest centre isn't the one at 0 (ties go to the first)."""
    rows = weninger(blocks, key, sigma)
    centers = centers or kmeans_centers(rows, **options)
    far = lambda c: F.pow(F.col("w_smooth") - c[0], 2) + F.pow(F.col("w_absdiff") - c[1], 2)
    first, *others = [far(c) for c in centers]
    return rows.withColumn("cw", (first > F.least(*others, first) if others else F.lit(False)).cast("int"))


class Standardized:
    """A feature with mean 0 and standard deviation 1 in each column.

    ``fit`` takes population statistics of all rows; constant columns are only
    centred.
    """

    def __init__(self, make: Callable[..., DataFrame], columns: tuple[str, ...], stats: dict[str, tuple[float, float]] | None = None):
        self.make, self.columns, self.stats = make, columns, stats

    def fit(self, blocks: DataFrame, key: str = "page_id") -> "Standardized":
        rows = self.make(blocks, key=key)
        aggregates = chain.from_iterable((F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")) for c in self.columns)
        r = rows.agg(*aggregates).first()
        stats = {c: (r[f"m_{c}"] or 0.0, r[f"s_{c}"] or 1.0) for c in self.columns}
        return Standardized(self.make, self.columns, stats)

    def __call__(self, blocks: DataFrame, key: str = "page_id") -> DataFrame:
        if self.stats is None:
            raise ValueError("fit it first")
        rows = self.make(blocks, key=key)
        return rows.withColumns({c: (F.col(c) - m) / s for c, (m, s) in self.stats.items()})


#: name -> (function, its columns)
REGISTRY: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...]]] = {
    "css": (css, CSS),
    "kohlschuetter": (kohlschuetter, DENSITY),
    "readability": (readability, READABILITY),
    "weninger": (weninger, SMOOTH),
    "clustered_weninger": (clustered_weninger, CLUSTERED),
}


def get_feature(name: str) -> tuple[Callable[..., DataFrame], tuple[str, ...]]:
    if name not in REGISTRY:
        raise ValueError(f"no feature {name!r}; there are {', '.join(REGISTRY)}")
    return REGISTRY[name]


def union(features) -> tuple[Callable[..., DataFrame], tuple[str, ...]]:
    """One feature of several: a name, a (function, columns) pair, a
    ``Standardized``, or a list of those or of (label, feature) pairs."""
    parts = [p for _, p in named(features)]

    def make(blocks: DataFrame, key: str = "page_id") -> DataFrame:
        for function, _ in parts:
            blocks = function(blocks, key=key)
        return blocks

    return make, tuple(chain.from_iterable(c for _, c in parts))


def named(features) -> list[tuple[str, tuple[Callable[..., DataFrame], tuple[str, ...]]]]:
    """(name, (function, columns)) of each of ``features``, given as to ``union``."""
    if not features:
        raise ValueError("no features given")

    def one(f) -> tuple[str, tuple[Callable[..., DataFrame], tuple[str, ...]]]:
        if isinstance(f, str):
            return f, get_feature(f)
        if isinstance(f, Standardized):
            return f"standardized_{f.make.__name__}", (f, f.columns)
        if isinstance(f, tuple) and len(f) == 2:
            return (f[0], one(f[1])[1]) if isinstance(f[0], str) else (f[0].__name__, f)
        raise ValueError(f"not a feature: {f!r}")

    return [one(f) for f in features] if isinstance(features, list) else [one(features)]
