"""Pages, gold texts and gold blocks in files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text

#: What stands between content and comments in a gold text.
COMMENTS_DELIMITER = r"!@#\$%\^&\*\(\)\s+COMMENTS"
GOLD_BLOCK_SCHEMA = "frac_content double, frac_comments double, block_tokens string, content_tokens string, comment_tokens string"


def list_files(spark: SparkSession, path: str, match: str | None = None, extension: str | None = None, full_path: bool = True) -> DataFrame:
    """(path) of the files in a folder, sorted; a missing folder raises OSError.

    match: a regular expression found anywhere in the name; extension: with or
    without its dot. Contents aren't read.
    """
    reader = spark.read.format("binaryFile")
    if extension:
        reader = reader.option("pathGlobFilter", f"*.{extension.lstrip('.')}")
    try:
        files = reader.load(path).select("path")
        files = files.unionByName(_empty(spark, path, f"*.{extension.lstrip('.')}" if extension else "*").select("path"))
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise OSError(f"no folder {path}") from e
        raise
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    if match:
        re.compile(match)
        files = files.filter(name.rlike(match))
    return files.select((F.col("path") if full_path else name).alias("path")).orderBy("path")


def _empty(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, content) of the files without a byte, which the reader of files passes over.

    They are listed as that reader lists all of them, on the driver, by name only.
    """
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{glob}")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    names = [(s.getPath().toString(),) for s in found if s.isFile() and not s.getLen()]
    return spark.createDataFrame(names, "path string").withColumn("content", F.lit(b""))


def decoded(content: Column, encoding: str | None = None) -> Column:
    """Text of bytes: in ``encoding``, or UTF-8 if they are, or UTF-16 by its mark, else Latin-1."""
    if encoding:
        return F.decode(content, encoding)
    marked = F.substring(F.hex(content), 1, 4).isin("FFFE", "FEFF")
    return F.when(marked, F.decode(content, "UTF-16")).otherwise(F.coalesce(F.try_validate_utf8(content), F.decode(content, "ISO-8859-1")))


def _files(spark: SparkSession, path: str, extension: str) -> DataFrame:
    rows = spark.read.format("binaryFile").option("pathGlobFilter", f"*{extension}").load(path).select("path", "content")
    rows = rows.unionByName(_empty(spark, path, f"*{extension}"))
    return rows.select(F.regexp_extract("path", rf"([^/]+?){re.escape(extension)}$", 1).alias("page_id"), "content")


def read_html(spark: SparkSession, path: str, encoding: str | None = None, extension: str = ".html") -> DataFrame:
    """(page_id, html) of a folder; the id is the name without extension.

    Text that was decoded wrongly before it was stored is mended; white space at both
    ends goes.
    """
    html = text.mended(decoded(F.col("content"), encoding))
    return _files(spark, path, extension).select("page_id", text.squeeze_ends(html).alias("html"))


def read_gold_texts(spark: SparkSession, path: str, encoding: str | None = None, extension: str = ".html.corrected.txt", tagged: bool = False) -> DataFrame:
    """(page_id, content, comments); tagged: tags are removed and there are no comments."""
    rows = _files(spark, path, extension).select("page_id", decoded(F.col("content"), encoding).alias("t"))
    clean = lambda c: F.coalesce(text.squeeze_ends(c), F.lit(""))
    if tagged:
        plain = F.regexp_replace("t", r"<[^>]*>", "")
        return rows.select("page_id", clean(plain).alias("content"), F.lit("").alias("comments"))
    parts = F.split("t", COMMENTS_DELIMITER, 2)
    return rows.select("page_id", clean(F.get(parts, F.lit(0))).alias("content"), clean(F.get(parts, F.lit(1))).alias("comments"))


def write_gold_blocks(gold: DataFrame, path: str, key: str = "page_id") -> None:
    """Parquet, ordered within files; tokens stay arrays."""
    gold.sortWithinPartitions(key, "block_idx").write.mode("overwrite").parquet(path)


def write_gold_blocks_tsv(gold: DataFrame, path: str, key: str = "page_id") -> None:
    """Tab-separated lines of shares and tokens, a folder per page."""
    joined = [F.array_join(c, " ").alias(c) for c in ("block_tokens", "content_tokens", "comment_tokens")]
    rows = gold.select(key, "block_idx", F.format_string("%.6f", "frac_content").alias("frac_content"), F.format_string("%.6f", "frac_comments").alias("frac_comments"), *joined)
    rows.repartition(key).sortWithinPartitions(key, "block_idx").drop("block_idx").write.mode("overwrite").partitionBy(key).option("emptyValue", "").csv(path, sep="\t", quote="", escape="\\")


def read_gold_blocks_tsv(spark: SparkSession, path: str, split_blocks: bool = True) -> DataFrame:
    """Lines of one page's file in order, with block_idx; tokens as arrays if ``split_blocks``.

    A block's number is its line; blank lines don't count.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")).alias("block_idx", "line"))
    parts = F.split("line", "\t", -1)
    names = [c.split()[0] for c in GOLD_BLOCK_SCHEMA.split(", ")]
    if not split_blocks:
        return lines
    tokens = lambda i: F.filter(F.split(F.coalesce(F.get(parts, F.lit(i)), F.lit("")), " "), lambda x: x != "")
    return lines.select("block_idx", *[F.get(parts, F.lit(i)).cast("double").alias(names[i]) for i in (0, 1)], *[tokens(i).alias(names[i]) for i in (2, 3, 4)])
