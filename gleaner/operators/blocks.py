"""Raw blocks to the blocks of a page.

A raw block without a token is empty: it is left out, but its tags count for the
next block that isn't. A block without a letter or digit ends such a run and is
left out only afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text
from gleaner.operators import events, parse


#: Bytes of the pages' files, and a size beyond which it isn't known, as that of a stream's batch.
PART_BYTES, UNKNOWN_BYTES = 4 << 20, 1 << 50


def parts_of(pages: DataFrame) -> int | None:
    """Into how many parts blocks of ``pages`` are exchanged; None leaves it to Spark, as for small tables.

    Sorts and windows hold a part, so their memory follows its size. Spark's number of
    parts is a setting; this one follows the pages, by the plan's estimate of their bytes.
    """
    size = int(str(pages._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = -(-size // PART_BYTES)
    return parts if pages.sparkSession.sparkContext.defaultParallelism < parts and size < UNKNOWN_BYTES else None


def tolerant_raw(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Raw blocks by the tolerant parser, exchanged by page."""
    raw, parts = parse.raw_blocks(pages, key, html), None if pages.isStreaming else parts_of(pages)
    return raw.repartition(parts, key) if parts else raw


def from_raw(raw: DataFrame, key: str = "page_id", extra: dict[str, Column] | None = None) -> DataFrame:
    """Blocks of raw blocks; ``extra`` adds columns computed from raw ones.

    With the columns of the tolerant parser, min_depth_since_last_block,
    ancestors, readability_class_weights and hrefs come along.
    """
    page = Window.partitionBy(key)
    order = page.orderBy("raw_block")
    rows = raw.withColumn("filled", (F.col("text") != "").cast("int"))
    rows = rows.withColumns({"run": F.coalesce(F.sum("filled").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "last": F.max("raw_block").over(page)})
    run = Window.partitionBy(key, "run")
    passed = F.sum(F.when(F.col("filled") == 0, F.col("n_tags") + 1).otherwise(0)).over(run)
    # the count takes in the next block's start tag in place of its own; the last block has no next one
    own = F.col("n_tags") + F.when(F.col("raw_block") == F.col("last"), 0).otherwise(1)
    columns = {"tagcount": own.cast("int"), "tagcount_since_last_block": passed.cast("int"), "anchor_count": F.col("n_anchors")}
    if "depth_start" in raw.columns:
        rows = rows.withColumn("turn", F.max(F.when(F.col("depth_tag").isNotNull(), F.col("raw_block"))).over(run))
        lowest = F.min(F.when(F.col("raw_block") < F.col("turn"), F.col("depth_low")).when(F.col("raw_block") == F.col("turn"), F.col("depth_tag"))).over(run)
        first = F.first("depth_start").over(run.orderBy("raw_block"))
        columns["min_depth_since_last_block"] = F.least(lowest, first)
        columns["readability_class_weights"] = F.flatten(F.collect_list("weights").over(run.orderBy("raw_block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        columns |= {"ancestors": F.col("ancestors"), "hrefs": F.col("hrefs")}
    rows = rows.withColumns(columns).filter((F.col("filled") == 1) & text.has_word(F.col("text")))
    rows = rows.withColumns({"block_idx": F.row_number().over(order) - 1, **(extra or {})})
    names = [key, "block_idx", "text", "link_text", "css_id", "css_class", F.col("start_tag").alias("block_start_tag"), *columns, *(extra or {})]
    rows = rows.select(*names)
    return rows.withColumns({"n_bytes": F.octet_length("text"), "link_density": text.link_density(F.col("link_text"), F.col("text")), "text_density": text.text_density(F.col("text"))})


def blocks(pages: DataFrame, key: str = "page_id", html: str = "html", tolerant: bool = False, extra: dict[str, Column] | None = None) -> DataFrame:
    """The blocks of pages: by expressions alone, or ``tolerant`` with the parser.

    Pages that can't be parsed (null, empty, nothing but a comment) have none.
    """
    made = tolerant_raw(pages, key, html) if tolerant else events.raw_blocks(pages, key, html)
    return from_raw(made, key, extra)


#: Columns that the blockifier variants keep, besides key, block_idx, text and densities.
VARIANTS = {
    "plain": (),
    "tag_count": ("tagcount", "tagcount_since_last_block", "anchor_count", "min_depth_since_last_block", "css_id", "css_class"),
    "tag_count_no_css": ("tagcount", "tagcount_since_last_block", "anchor_count", "min_depth_since_last_block"),
    "tag_count_readability": ("tagcount", "tagcount_since_last_block", "anchor_count", "min_depth_since_last_block", "css_id", "css_class", "ancestors", "readability_class_weights", "block_start_tag"),
    "tag_count_no_css_readability": ("tagcount", "tagcount_since_last_block", "anchor_count", "min_depth_since_last_block", "ancestors", "readability_class_weights", "block_start_tag"),
}


class BlockifyError(ValueError):
    """A page that can't be parsed, where that is asked to be an error."""


def blockify(pages: DataFrame, variant: str = "tag_count_no_css_readability", key: str = "page_id", html: str = "html", strict: bool = False, parse_callback=None) -> DataFrame:
    """The blocks of a variant, by the tolerant parser.

    strict: raise BlockifyError if a page can't be parsed. parse_callback: called
    with the table of raw blocks before they are made into blocks.
    """
    if variant not in VARIANTS:
        raise ValueError(f"no variant {variant!r}; there are {', '.join(VARIANTS)}")
    if strict:
        bad = pages.filter(~parse.parseable(F.col(html))).limit(1).count()
        if bad:
            raise BlockifyError("a page is null, empty or nothing but a comment")
    raw = tolerant_raw(pages, key, html)
    if parse_callback is not None:
        parse_callback(raw)
    return from_raw(raw, key).select(key, "block_idx", "text", "link_text", "link_density", "text_density", "n_bytes", *VARIANTS[variant])
