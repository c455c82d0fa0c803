"""Queries over the tables of a folder, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text
from gleaner.operators import blocks as block_ops
from gleaner.operators import events, features, labels, metrics, model, parse
from gleaner.plans import oracles
from gleaner.sources import files
from gleaner.sources.folders import is_folder, new_folder
from gleaner.streaming import extract as streaming

DIGITS = 6
CENTERS = oracles.CENTERS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "html")


def strict_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks by expressions alone."""
    return block_ops.blocks(pages(spark, sf_dir))


def tolerant_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks by the tolerant parser."""
    return block_ops.blocks(pages(spark, sf_dir), tolerant=True)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, DIGITS) for c in columns})


def page_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", text.guess_encoding(F.col("html")).alias("encoding"))


def page_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.page_events(pages(spark, sf_dir))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.subtree_texts(pages(spark, sf_dir)).select("page_id", text.squeeze(F.array_join("texts", " ")).alias("text"))


def raw_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.raw_blocks(pages(spark, sf_dir))


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strict_blocks(spark, sf_dir).select("page_id", "block_idx", "text", "link_text", "block_start_tag", "css_id", "css_class", "n_bytes")


def block_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(strict_blocks(spark, sf_dir).select("page_id", "block_idx", "link_density", "text_density"), "link_density", "text_density")


def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strict_blocks(spark, sf_dir).select("page_id", "block_idx", "tagcount", "tagcount_since_last_block", "anchor_count")


def css_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.css(strict_blocks(spark, sf_dir)).select("page_id", "block_idx", *features.CSS)


def kohlschuetter_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.kohlschuetter(strict_blocks(spark, sf_dir)).select("page_id", "block_idx", *features.DENSITY)
    return rounded(rows, *features.DENSITY)


def ctr_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.weninger(strict_blocks(spark, sf_dir)).select("page_id", "block_idx", *features.SMOOTH)
    return rounded(rows, *features.SMOOTH)


def feature_standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("link_density", "text_density")
    made = features.Standardized(lambda b, key="page_id": b, columns)
    rows = strict_blocks(spark, sf_dir).select("page_id", "block_idx", *columns)
    return rounded(made.fit(rows)(rows), *columns)


def enough_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.enough_blocks(strict_blocks(spark, sf_dir)).groupBy("page_id").agg(F.count("*").alias("n_blocks"))


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = text.word_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).alias("n_words"), F.size(F.array_distinct(words)).alias("n_distinct"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's words beside those of the turn before."""
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.word_tokens(F.lower("text")).alias("predicted"))
    before = words.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("predicted").alias("actual"))
    return words.join(before, ["conv_id", "turn"])


def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = metrics.token_overlap(F.col("predicted"), F.col("actual"))
    return turns(spark, sf_dir).select("conv_id", "turn", *[F.round(c, DIGITS).alias(n) for n, c in scores.items()])


def token_overlap_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).withColumn("key", F.struct("conv_id", "turn"))
    scores = metrics.token_overlap_counted(rows, "key", "predicted", "actual")
    return rounded(scores, "precision", "recall", "f1").select("key.*", "precision", "recall", "f1")


def token_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("conv_id", "turn", F.round(metrics.token_jaccard(F.col("predicted"), F.col("actual")), DIGITS).alias("jaccard"))


def block_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a rule of densities finds the blocks that start with a paragraph."""
    rows = strict_blocks(spark, sf_dir).select(
        (F.col("block_start_tag") == "p").cast("int").alias("label"),
        ((F.col("text_density") > 8) & (F.col("link_density") < 0.3)).cast("int").alias("pred"),
        F.size(F.split("text", " ")).alias("weight"),
    )
    return rounded(metrics.classification(rows, "label", "pred", "weight"), "accuracy", "precision", "recall", "f1")


def osa_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the words of each turn and of the one before."""
    return turns(spark, sf_dir).select("conv_id", "turn", metrics.osa_distance("predicted", "actual").alias("distance"))


def tolerant_page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same columns as ``page_blocks``, by the tolerant parser."""
    return tolerant_blocks(spark, sf_dir).select("page_id", "block_idx", "text", "link_text", "block_start_tag", "css_id", "css_class", "n_bytes")


def tolerant_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tolerant_blocks(spark, sf_dir).select("page_id", "block_idx", "tagcount", "tagcount_since_last_block", "anchor_count")


def min_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tolerant_blocks(spark, sf_dir).select("page_id", "block_idx", "min_depth_since_last_block")


def block_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ancestors and class weights as text: numbers, and number:weight pairs."""
    weights = F.transform("readability_class_weights", lambda w: F.concat_ws(":", w["node_id"], w["weight"]))
    joined = [F.array_join(F.transform("ancestors", lambda a: a.cast("string")), " ").alias("ancestors"), F.array_join(weights, " ").alias("class_weights")]
    return tolerant_blocks(spark, sf_dir).select("page_id", "block_idx", "block_start_tag", *joined)


def readability_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.readability(tolerant_blocks(spark, sf_dir)).select("page_id", "block_idx", "readability"), "readability")


def kmeans_ctr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.clustered_weninger(strict_blocks(spark, sf_dir)).select("page_id", "block_idx", "cw")


def ctr_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clusters' side of k-means alone, with given centres."""
    made = features.clustered_weninger(strict_blocks(spark, sf_dir), centers=CENTERS)
    return made.select("page_id", "block_idx", "cw")


def block_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    extractor = model.Extractor()
    return rounded(extractor.predict(extractor.blocks(pages(spark, sf_dir))).select("page_id", "block_idx", "prob", "pred"), "prob")


def extracted_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: main text of every page."""
    return model.extract_content(pages(spark, sf_dir))


def streamed_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship over a stream of the pages' file or files; output and state in a new folder."""
    at, name = new_folder(spark, "stream"), "pages.parquet"
    source = streaming.page_stream(spark, f"{sf_dir}/{name}") if is_folder(spark, f"{sf_dir}/{name}") else streaming.page_stream(spark, sf_dir, name)
    query = streaming.extract_stream(source, f"{at}/out", f"{at}/state")
    query.awaitTermination()
    return spark.read.parquet(f"{at}/out").select("page_id", "content")


def gold_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, content, comments) from the pages' visible structure: their article, and
    in place of comments, which they haven't, their advertisement."""
    within = lambda start, end: text.squeeze(text.unescape(F.regexp_replace(F.regexp_extract("html", f"(?s){start}(.*?){end}", 1), r"<[^>]*>", " ")))
    return pages(spark, sf_dir).select("page_id", within("<article>", "</article>").alias("content"), within('<div class="ad">', "</div>").alias("comments"))


def gold_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = labels.gold_blocks(tolerant_blocks(spark, sf_dir), gold_texts(spark, sf_dir))
    joined = [F.array_join(c, " ").alias(c) for c in ("block_tokens", "content_tokens", "comment_tokens")]
    return rounded(made, "frac_content", "frac_comments").select("page_id", "block_idx", "frac_content", "frac_comments", *joined)


def block_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.block_labels(labels.gold_blocks(tolerant_blocks(spark, sf_dir), gold_texts(spark, sf_dir)))


def label_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each page, the words in blocks and those labelled content, comments and either."""
    made = labels.block_labels(labels.gold_blocks(tolerant_blocks(spark, sf_dir), gold_texts(spark, sf_dir)))
    words = lambda label: F.sum(F.col("weight") * label)
    either = labels.merged(F.col("content"), F.col("comments"))
    return made.groupBy("page_id").agg(F.sum("weight").alias("words"), words(F.col("content")).alias("content_words"), words(F.col("comments")).alias("comment_words"), words(either).alias("labelled_words"))


def page_gold_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each page's blocks that its gold content has, in order."""
    made = labels.content_tokens(labels.gold_blocks(tolerant_blocks(spark, sf_dir), gold_texts(spark, sf_dir)))
    return made.select("page_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


def unprocessed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without a block that has enough words for content."""
    done = strict_blocks(spark, sf_dir).filter("text_density > 12")
    return labels.unprocessed(pages(spark, sf_dir), done).select("page_id")


def lcs_inclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of each turn are in common with the one before."""
    flags = labels.inclusion("predicted", "actual")
    return turns(spark, sf_dir).select("conv_id", "turn", F.array_join(F.transform(flags, lambda x: x.cast("int").cast("string")), "").alias("flags"))


def token_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("conv_id", "turn", F.array_join(labels.differences("predicted", "actual"), "\n").alias("diff"))


def variant(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """The blocks of a blockifier variant, lists as text."""

    def blocks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = block_ops.blockify(pages(spark, sf_dir), name)
        lists = {"ancestors": F.array_join(F.transform("ancestors", lambda a: a.cast("string")), " "), "readability_class_weights": F.array_join(F.transform("readability_class_weights", lambda w: F.concat_ws(":", w["node_id"], w["weight"])), " ")}
        return rounded(made.withColumns({c: x for c, x in lists.items() if c in made.columns}), "link_density", "text_density")

    blocks_of.__name__ = f"blocks_{name}"
    return blocks_of


def casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to bytes and back, alone, in lists and in maps."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.array("role", "text").alias("list"), F.create_map("role", "text").alias("map"))
    return rows.select(
        "conv_id",
        "turn",
        F.octet_length(text.to_bytes(F.col("text"))).alias("n_bytes"),
        text.to_text(text.to_bytes(F.col("text"))).alias("text"),
        F.array_join(text.to_text_list(text.to_bytes_list(F.col("list"))), "|").alias("list"),
        F.array_join(F.map_values(text.to_text_map(text.to_bytes_map(F.col("map")))), "|").alias("map"),
    )


def gold_block_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold blocks of all pages, written as tables and read again."""
    at = new_folder(spark, "gold")
    files.write_gold_blocks(labels.gold_blocks(tolerant_blocks(spark, sf_dir), gold_texts(spark, sf_dir)), at)
    made = labels.read_again(spark.read.parquet(at))
    return made.select("page_id", "block_idx", F.size("block_tokens").alias("n_tokens"), F.array_join("block_tokens", " ").alias("block_tokens"))


def stored_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content by the built-in model, written with its features and loaded."""
    at = new_folder(spark, "model")
    model.Extractor().save(spark, at)
    return model.Extractor.load(spark, at).extract(pages(spark, sf_dir))


def forest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block metrics of a forest trained on article labels, on both parts of the split."""
    gold = labels.block_labels(labels.gold_blocks(tolerant_blocks(spark, sf_dir), gold_texts(spark, sf_dir)))
    _, report = model.train_model(model.Extractor(model=model.forest()), pages(spark, sf_dir), gold)
    return rounded(report, "accuracy", "precision", "recall", "f1")


def extracted_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content, comments and both of every page; the models of the last two are trained
    on all pages, stored and loaded.

    Pages are parsed once: blocks with their features are written and read again, by
    the alignment, the training of both models and all three extractions.
    """
    found, kinds = model.Models(), ("content", "comments", "content_and_comments")
    at, columns = new_folder(spark, "blocks"), model.Extractor().columns
    model.training_rows(model.Extractor(), tolerant_blocks(spark, sf_dir)).select("page_id", "block_idx", "n_blocks", "text", *columns).write.parquet(at)
    rows = spark.read.parquet(at)
    gold = labels.block_labels(labels.gold_blocks(rows, gold_texts(spark, sf_dir)))
    known = rows.filter("n_blocks >= 3").select("page_id", "block_idx", *columns).join(gold, ["page_id", "block_idx"]).persist()
    for name in kinds[1:]:
        found.paths[name] = new_folder(spark, name)
        start = model.Extractor(to_extract=tuple(name.split("_and_")), cap_weights=True, max_block_weight=50)
        start.with_model(model.fit_logistic_rows(start, start.targets_of(known, beside=columns))).save(spark, found.paths[name])
    known.unpersist()
    return model.extract_kinds(pages(spark, sf_dir), rows, {name: found.get(name, spark) for name in kinds})


NAMED: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    page_encoding, page_events, page_texts, raw_blocks, page_blocks, block_density, tag_counts, css_features, kohlschuetter_features,
    ctr_smoothed, feature_standardised, enough_blocks, document_words, token_overlap, token_overlap_counted, token_jaccard, block_metrics,
    osa_distance, tolerant_page_blocks, tolerant_tag_counts, min_depths, block_ancestors, readability_scores, kmeans_ctr, block_probabilities,
    extracted_content, streamed_content, gold_blocks, block_labels, lcs_inclusion, token_diff, forest_metrics, ctr_clusters, label_summary,
    page_gold_tokens, unprocessed_pages, casts, gold_block_files, stored_model, extracted_kinds, *map(variant, block_ops.VARIANTS),
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in NAMED}


def oracle_sql() -> dict[str, str]:
    twins = {"tolerant_page_blocks": "page_blocks", "tolerant_tag_counts": "tag_counts"}
    return oracles.SQL | {name: oracles.SQL[of] for name, of in twins.items()}
