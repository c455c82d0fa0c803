"""Pages to an ordered table of tags and texts, in Catalyst expressions only.

This tokenizer is for complete pages whose ignored elements and anchors are
closed; ``gleaner.operators.parse`` reads anything.

Pages are exchanged once, by page, before they are taken apart. All windows and
aggregates by page that follow keep that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import tags, text

TOKENS = r"(<[^>]*>|[^<]+)"
NAME = r"^</?([a-zA-Z][a-zA-Z0-9:-]*)"


def attribute(token: Column, name: str) -> Column:
    """The value of an attribute of a tag, '' without one."""
    pattern = rf"""(?i)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*[F.regexp_extract(token, pattern, i) for i in (1, 2, 3)])


def cleaned(html: Column) -> Column:
    """Without comments and the bodies of scripts and styles."""
    html = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for tag in ("script", "style"):
        html = F.regexp_replace(html, rf"(?is)(<{tag}[^>]*>).*?</{tag}\s*>", f"$1</{tag}>")
    return html


def page_events(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, kind, tag, attr_id, attr_class, href, text); kind: open, close, text.

    Null and empty pages give no event.
    """
    tokens = F.regexp_extract_all(cleaned(F.col(html)), F.lit(TOKENS), F.lit(1))
    rows = pages.select(key, html).repartition(key).select(key, F.posexplode(tokens).alias("pos", "token"))
    tag = F.lower(F.regexp_extract("token", NAME, 1))
    kind = F.when(~F.col("token").startswith("<"), "text").when(F.col("token").startswith("</"), "close").otherwise("open")
    rows = rows.select(key, "pos", kind.alias("kind"), tag.alias("tag"), "token").filter("kind = 'text' OR tag <> ''")
    start = F.col("kind") == "open"
    none = F.lit("")
    return rows.select(
        key,
        "pos",
        "kind",
        "tag",
        F.when(start, attribute(F.col("token"), "id")).otherwise(none).alias("attr_id"),
        F.when(start, attribute(F.col("token"), "class")).otherwise(none).alias("attr_class"),
        F.when(start & (F.col("tag") == "a"), attribute(F.col("token"), "href")).otherwise(none).alias("href"),
        F.when(F.col("kind") == "text", text.unescape(F.col("token"))).otherwise(none).alias("text"),
    )


def placed(events: DataFrame, key: str = "page_id") -> DataFrame:
    """Events with what surrounds them: ignored, anchored (booleans), raw_block.

    ignored: inside an ignored element, itself not included; anchored likewise.
    raw_block: the number of block starts so far. One sort serves all windows.
    """
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    holds = ~F.col("tag").isin(*tags.VOID)
    step = lambda inside: F.when(inside & (F.col("kind") == "open"), 1).when(inside & (F.col("kind") == "close"), -1).otherwise(0)
    rows = events.withColumn("ignore_step", step(F.col("tag").isin(*tags.IGNORED) & holds))
    rows = rows.withColumn("ignored", F.sum("ignore_step").over(w) - F.greatest("ignore_step", F.lit(0)) > 0)
    rows = rows.withColumn("anchor_step", step((F.col("tag") == "a") & ~F.col("ignored")))
    rows = rows.withColumn("anchored", F.sum("anchor_step").over(w) - F.greatest("anchor_step", F.lit(0)) > 0)
    rows = rows.withColumn("starts", (F.col("kind") == "open") & F.col("tag").isin(*tags.BLOCK_STARTS) & ~F.col("ignored") & ~F.col("anchored"))
    return rows.withColumn("raw_block", F.sum(F.col("starts").cast("int")).over(w)).drop("ignore_step", "anchor_step")


def raw_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per block start, blocks without text included.

    (key, raw_block, start_tag, text, link_text, css_id, css_class, n_tags, n_anchors)
    """
    rows = placed(page_events(pages, key, html), key)
    counted = (F.col("kind") == "open") & ~F.col("ignored") & (F.col("tag") != "html")
    styled = counted & ~F.col("anchored") & ~F.col("tag").isin(*tags.IGNORED)
    read = (F.col("kind") == "text") & ~F.col("ignored")
    joined = lambda column, where: text.squeeze(F.coalesce(F.expr(f"listagg(CASE WHEN {where} THEN {column} END, ' ') WITHIN GROUP (ORDER BY pos)"), F.lit("")))
    rows = rows.withColumns({"counted": counted, "styled": styled, "read": read})
    return rows.groupBy(key, "raw_block").agg(
        F.coalesce(F.max(F.when(F.col("starts"), F.col("tag"))), F.lit("")).alias("start_tag"),
        joined("text", "read").alias("text"),
        joined("text", "read AND anchored").alias("link_text"),
        F.lower(joined("attr_id", "styled AND attr_id <> ''")).alias("css_id"),
        F.lower(joined("attr_class", "styled AND attr_class <> ''")).alias("css_class"),
        F.count_if(F.col("counted") & ~F.col("starts")).cast("int").alias("n_tags"),
        F.count_if(F.col("counted") & (F.col("tag") == "a")).cast("int").alias("n_anchors"),
    )


def subtree_texts(pages: DataFrame, exclude: tuple[str, ...] = tags.IGNORED, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, texts): all texts of a page in order, without those in ``exclude``."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    holds = F.col("tag").isin(*exclude) & ~F.col("tag").isin(*tags.VOID)
    step = F.when(holds & (F.col("kind") == "open"), 1).when(holds & (F.col("kind") == "close"), -1).otherwise(0)
    rows = page_events(pages, key, html).withColumn("depth", F.sum(step).over(w)).filter("kind = 'text' AND depth = 0")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return rows.groupBy(key).agg(F.transform(ordered, lambda x: x["text"]).alias("texts"))
