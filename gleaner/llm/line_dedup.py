"""Line dedup with sharded cuckoo filters over exact reference counts.

Lines are dealt by hash into shards. A shard has an exact table, the number of
references of each line, and in front of it a cuckoo filter: a line that the
filter doesn't know is new, without a look at the table; one that it seems to know
is looked up, so a false positive costs a lookup but never a line. Deleting a
document takes its references back, and a line without references leaves table
and filter, so insertions can be undone.

``LineIndex`` keeps both in a folder that all executors share. A change adds its
differences to the exact table and new filters of the shards that it touches; what
other shards hold isn't read. ``drop_repeated_lines`` puts a whole table into an
index: the first occurrence of a line in order of document id and line, unless the
index has the line already, stays. Occurrences of a line are summed before they are
exchanged, so a line that half the corpus has is no hot key.

Defined results
---------------
* Lines are compared without spaces at both ends. Blank lines are no lines: they
  stay and count for nothing.
* A document of which every line is dropped goes; null texts, empty texts and
  texts of blank lines stay as they are, in every row.
* Documents without an id come last, in order of their text's hash. Rows of one
  id with unlike texts are several documents. Of rows with the same id and text,
  whatever their other columns, the later ones hold nothing but repeated lines:
  the first, in order of the hash of the other columns, is left.
* Other columns are kept, except that ``n_chars``, if there, follows the text. A
  column of the name of the count is replaced by it.
* References are counted by row: a row inserted twice is to be deleted twice.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.shared import checkpointed, ensure_checkpoint_dir, exists, is_missing, read_table, remove, sort_id

SLOTS = 4
KICKS = 500
#: Lines of a shard, as a new index is laid out: a filter of 4 MB.
SHARD_LINES = 1_000_000
#: Up to so many shards are named in a filter on the exact table.
NAMED_SHARDS = 4096
BROADCAST_BYTES = 64 << 20


class CuckooFilter:
    """16-bit fingerprints in buckets of four; supports deletion."""

    def __init__(self, capacity: int = 1024):
        buckets = 1
        while buckets * SLOTS * 0.85 < capacity:
            buckets *= 2
        self.table = np.zeros((buckets, SLOTS), np.uint16)
        self.count = 0
        self._random = np.random.default_rng(5)

    @classmethod
    def of(cls, hashes: np.ndarray) -> "CuckooFilter":
        """One that holds distinct lines, with room for as many more."""
        capacity = max(1024, 2 * len(hashes))
        while True:
            made = cls(capacity)
            if made.add(hashes):
                return made
            capacity *= 2

    @classmethod
    def read(cls, data: bytes) -> "CuckooFilter":
        made = cls(0)
        made.table = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        made.count = int(np.count_nonzero(made.table))
        return made

    def write(self) -> bytes:
        return self.table.tobytes()

    @property
    def capacity(self) -> int:
        return int(self.table.size * 0.85)

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        h = hashes.astype(np.uint64)
        print_ = np.maximum(h >> np.uint64(48), np.uint64(1))
        one = h & mask
        return print_.astype(np.uint16), one.astype(np.int64), (one ^ self._jump(print_, mask)).astype(np.int64)

    @staticmethod
    def _jump(print_: np.ndarray, mask: np.uint64) -> np.ndarray:
        return (print_ * np.uint64(0x5BD1E9955BD1E995) >> np.uint64(17)) & mask

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        p, a, b = self._places(hashes)
        return (self.table[a] == p[:, None]).any(axis=1) | (self.table[b] == p[:, None]).any(axis=1)

    def add(self, hashes: np.ndarray) -> bool:
        """Adds distinct lines; False when it is too full, and then to be made anew."""
        p, a, b = self._places(hashes)
        left = np.arange(len(p))
        for place in (a, b):
            order = left[np.argsort(place[left], kind="stable")]
            at = place[order]
            start = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.empty(0, bool)
            index = np.arange(len(at))
            rank = index - np.maximum.accumulate(np.where(start, index, 0)) if len(at) else index
            free = self.table[at] == 0
            fits = rank < free.sum(axis=1)
            slot = (np.cumsum(free[fits], axis=1) == (rank[fits] + 1)[:, None]).argmax(axis=1)
            self.table[at[fits], slot] = p[order[fits]]
            left = order[~fits]
        for i in left:
            if not self._kick(p[i], int(b[i])):
                return False
        self.count += len(p)
        return True

    def _kick(self, print_: np.uint16, at: int) -> bool:
        mask = np.uint64(len(self.table) - 1)
        for _ in range(KICKS):
            row = self.table[at]
            free = np.flatnonzero(row == 0)
            if len(free):
                row[free[0]] = print_
                return True
            slot = int(self._random.integers(SLOTS))
            print_, row[slot] = row[slot], print_
            at = int(np.uint64(at) ^ self._jump(np.array([print_], np.uint64), mask)[0])
        return False

    def remove(self, hashes: np.ndarray) -> None:
        for p, a, b in zip(*self._places(hashes)):
            for at in (a, b):
                slot = np.flatnonzero(self.table[at] == p)
                if len(slot):
                    self.table[at, slot[0]] = 0
                    self.count -= 1
                    break


def lines_of(docs: DataFrame) -> DataFrame:
    """id, version (the text's hash), line_no, h1, h2 of every line that isn't blank."""
    rows = docs.filter("text IS NOT NULL").select(sort_id().alias("id"), F.xxhash64("text").alias("version"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    rows = rows.select("id", "version", "line_no", F.trim("line").alias("line")).filter("line <> ''")
    return rows.select("id", "version", "line_no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def summed(docs: DataFrame) -> DataFrame:
    """h1, h2, refs (occurrences) and the first one's id, version, line_no, of every line."""
    at = F.struct("id", "version", "line_no")
    return lines_of(docs).groupBy("h1", "h2").agg(F.count("*").alias("refs"), F.min(at).alias("at")).select("h1", "h2", "refs", "at.*")


def shard_of(shards: int):
    """By the hash that the filters don't take their places from."""
    return F.pmod("h2", F.lit(shards)).cast("int")


class LineIndex:
    """Exact table and filters in a folder that all executors share.

    ``refs/v=N/shard=K`` has what change N added to or took from the counts,
    ``filters/v=N`` the filters that it made anew, ``commits`` a row for each change
    that is complete. A change that fails leaves the index as it was; opening the
    folder finds the last complete one. One writer at a time. Without ``shards``, the
    first insertion lays out as many as its lines need.
    """

    _REFS = "h1 long, h2 long, refs long, v int, shard int"
    _FILTERS = "shard int, filter binary, v int"
    _COMMITS = "version int, base int, shards int"

    def __init__(self, spark: SparkSession, path: str, shards: int | None = None):
        self.spark, self.path = spark, path
        last = self._read("commits", self._COMMITS).selectExpr("max(struct(version, base, shards)) AS last").first()["last"] if exists(spark, f"{path}/commits") else None
        self.version, self.base, self.shards = (last["version"], last["base"], last["shards"]) if last else (0, 1, shards)

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as e:
            if not is_missing(e):
                raise
            return self.spark.createDataFrame([], schema)

    def _current(self, name: str, schema: str) -> DataFrame:
        return self._read(name, schema).filter(F.col("v").between(self.base, self.version))

    def refs(self) -> DataFrame:
        """The exact table: shard, h1, h2, refs."""
        return self._current("refs", self._REFS).groupBy("shard", "h1", "h2").agg(F.sum("refs").alias("refs")).filter("refs > 0")

    def filters(self) -> DataFrame:
        """shard, filter: the last one of each shard."""
        return self._current("filters", self._FILTERS).groupBy("shard").agg(F.max_by("filter", "v").alias("filter"))

    def insert(self, docs: DataFrame) -> DataFrame:
        """Adds the lines of ``docs``; id, version, line_no of the first occurrences of those that are new."""
        return self._change(docs, False).filter("old = 0").select("id", "version", "line_no")

    def delete(self, docs: DataFrame) -> None:
        """Takes the lines of ``docs`` back, whose texts must be those inserted; unknown lines are ignored."""
        self._change(docs, True)

    def _known(self, lines: DataFrame) -> DataFrame:
        """shard, h1, h2, old: references so far of the lines that the filters don't rule out."""

        def ask(_: tuple, filters: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            if not len(filters) or not len(asked):
                return asked.iloc[:0]
            found = CuckooFilter.read(filters["filter"].iloc[0]).contains(asked["h1"].to_numpy(np.int64).view(np.uint64))
            return asked[found]

        asked = lines.select("shard", "h1", "h2")
        maybe = checkpointed(self.filters().groupBy("shard").cogroup(asked.groupBy("shard")).applyInPandas(ask, "shard int, h1 long, h2 long"))
        table = self.refs()
        touched = [r["shard"] for r in maybe.select("shard").distinct().limit(NAMED_SHARDS + 1).collect()]
        if len(touched) <= NAMED_SHARDS:
            table = table.filter(F.col("shard").isin(touched))
        return table.join(maybe, ["shard", "h1", "h2"]).withColumnRenamed("refs", "old")

    def _change(self, docs: DataFrame, deleting: bool) -> DataFrame:
        """The lines of ``docs`` as ``summed`` gives them, with old, the references before."""
        lines = checkpointed(summed(docs))
        self.shards = self.shards or -(-lines.count() // SHARD_LINES) or 1
        lines = lines.withColumn("shard", shard_of(self.shards))
        if self.version:
            lines = checkpointed(lines.join(self._known(lines), ["shard", "h1", "h2"], "left").fillna(0, ["old"]))
        else:
            lines = lines.withColumn("old", F.lit(0).cast("long"))
        step = -F.least("refs", "old") if deleting else F.col("refs")
        changed = lines.select("shard", "h1", "h2", step.alias("refs")).filter("refs <> 0")
        # a shard's rows together, so that it gets one file
        self._write(changed.repartition("shard"), f"refs/v={self.version + 1}", "shard")
        self._write(self._filtered(lines.filter("old > 0 AND old <= refs" if deleting else "old = 0"), deleting), f"filters/v={self.version + 1}")
        self._commit(self.version + 1, self.base, self.shards)
        return lines

    def _filtered(self, moved: DataFrame, deleting: bool) -> DataFrame:
        """shard, filter of the shards that lines come to or leave."""

        def change(key: tuple, filters: pd.DataFrame, moved: pd.DataFrame) -> pd.DataFrame:
            if not len(moved):
                return pd.DataFrame({"shard": [], "filter": []}).astype({"shard": "int32"})
            keys = moved["h1"].to_numpy(np.int64).view(np.uint64)
            if not len(filters):
                return pd.DataFrame({"shard": [key[0]], "filter": [CuckooFilter.of(keys).write()]})
            found = CuckooFilter.read(filters["filter"].iloc[0])
            if deleting:
                found.remove(keys)
            elif found.count + len(keys) > found.capacity or not found.add(keys):
                return pd.DataFrame({"shard": [key[0]], "filter": [None]})
            return pd.DataFrame({"shard": [key[0]], "filter": [found.write()]})

        if not self.version:
            return self._built(moved)
        made = checkpointed(self.filters().groupBy("shard").cogroup(moved.select("shard", "h1").groupBy("shard")).applyInPandas(change, "shard int, filter binary"))
        full = made.filter("filter IS NULL").select("shard")
        if not full.limit(1).count():
            return made
        now = self._read("refs", self._REFS).filter(F.col("v").between(self.base, self.version + 1)).join(full, "shard", "left_semi")
        now = now.groupBy("shard", "h1", "h2").agg(F.sum("refs").alias("refs")).filter("refs > 0")
        return made.filter("filter IS NOT NULL").unionByName(self._built(now))

    @staticmethod
    def _built(table: DataFrame) -> DataFrame:
        build = lambda key, rows: pd.DataFrame({"shard": [key[0]], "filter": [CuckooFilter.of(rows["h1"].to_numpy(np.int64).view(np.uint64)).write()]})
        return table.select("shard", "h1").groupBy("shard").applyInPandas(build, "shard int, filter binary")

    def _write(self, df: DataFrame, name: str, by: str | None = None) -> None:
        """Only a change that didn't end can have left something there."""
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(f"{self.path}/{name}")

    def _commit(self, version: int, base: int, shards: int) -> None:
        self.spark.createDataFrame([(version, base, shards)], self._COMMITS).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        self.version, self.base, self.shards = version, base, shards

    def compact(self, shards: int | None = None) -> None:
        """Sums the changes so far into one, dealt into ``shards`` if given."""
        shards, version = shards or self.shards, self.version + 1
        table = checkpointed(self.refs().withColumn("shard", shard_of(shards)))
        self._write(table.select("shard", "h1", "h2", "refs").repartition("shard"), f"refs/v={version}", "shard")
        self._write(self._built(table), f"filters/v={version}")
        self._commit(version, version, shards)


def drop_repeated_lines(docs: DataFrame, index: LineIndex | None = None, removed: str | None = "lines_removed") -> DataFrame:
    """``docs`` with the first occurrence of every line only, and how many were removed.

    Without an index a new one is made in the shared checkpoint folder, and removed
    when it has told what is new. The number goes to the column ``removed``, or nowhere.
    """
    spark, own = docs.sparkSession, index is None
    if own:
        index = LineIndex(spark, f"{ensure_checkpoint_dir(spark)}/lines-{uuid.uuid4().hex}")
    columns = [c for c in docs.columns if c != removed]
    new = index.insert(docs)  # checkpointed, so the index isn't read again
    if own:
        remove(spark, index.path)
    fresh = new.groupBy("id", "version").agg(F.collect_list("line_no").alias("fresh"))
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    other = F.xxhash64(F.lit(0), *[F.col(f"`{c}`") for c in columns if c != "text"]).alias("other")
    rows = docs.select(row, sort_id().alias("id"), F.xxhash64("text").alias("version"), other, F.coalesce(F.col("text").rlike(r"[^ \n]"), F.lit(False)).alias("filled"))
    # the lines of repeated rows stay in the first
    again = checkpointed(rows.filter("filled").groupBy("id", "version").count().filter("count > 1").select("id", "version"))
    filled, many = rows.filter("filled"), again.count()
    if many:
        again = F.broadcast(again) if 16 * many <= BROADCAST_BYTES else again
        order = Window.partitionBy("id", "version").orderBy("other")
        first = filled.join(again, ["id", "version"], "left_semi").withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")
        filled = filled.join(again, ["id", "version"], "left_anti").unionByName(first)
    lines = F.split("row.text", "\n", -1)
    numbers = F.sequence(F.lit(0), F.size(lines) - 1)
    # set operations on numbers look each up in a hash table
    gone = F.array_except(F.filter(numbers, lambda i: F.trim(F.get("lines", i)) != ""), F.col("fresh"))
    # without a new line nothing is left
    joined = filled.join(fresh, ["id", "version"]).withColumn("lines", lines).withColumn("gone", gone)
    left = F.transform(F.array_except(numbers, F.col("gone")), lambda i: F.get("lines", i))
    changed = F.size("gone") > 0
    text = F.when(changed, F.array_join(left, "\n")).otherwise(F.col("row.text"))
    joined = joined.withColumn("now", text)
    names = {"text": F.col("now")}
    if "n_chars" in columns:
        names["n_chars"] = F.when(changed, F.length("now")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    count = lambda c: [c.alias(removed)] if removed else []
    kept = joined.select(*[names.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns], *count(F.size("gone")))
    return kept.unionByName(rows.filter("NOT filled").select("row.*", *count(F.lit(0))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that is left, with its text after dedup."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_lines(docs)


SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no
  FROM documents
), flagged AS (
  SELECT *, CASE WHEN trim(line) = '' THEN TRUE ELSE row_number() OVER (PARTITION BY trim(line) ORDER BY doc_id, line_no) = 1 END AS kept
  FROM lines
)
SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE kept) AS text,
  (count(*) FILTER (WHERE NOT kept))::INT AS lines_removed
FROM flagged GROUP BY doc_id
HAVING count(*) FILTER (WHERE NOT kept) = 0 OR count(*) FILTER (WHERE kept AND trim(line) <> '') > 0
"""
