"""Conflict-constrained best-fit packing of documents into training sequences.

Documents are placed in order of falling length. A bin keeps what is left of its
capacity, a bitmap of the sources in it and one of the duplicate clusters. Bins
are ordered by what they have left; the search starts at the first that could hold
the document and goes on to the next larger until it finds one with neither the
document's source nor its cluster: the tightest compatible bin. If there is none,
a bin is opened. Of equally tight bins the oldest is taken.

Packing is sequential, so documents are dealt by hash into shards that are packed
side by side. A shard has about ``SHARD_TOKENS`` tokens, so the number of shards
grows with the corpus, and what is lost is at most a few half-filled bins a shard.
A shard that rows of one id (or none) fill beyond twice that is dealt again, row by
row. Only ids, lengths, sources and cluster hashes are exchanged, no text.

Defined results
---------------
* The length is the number of words (runs of non-white space) unless
  ``length_col`` is given. Texts without a word and null texts take no place:
  they give no row.
* A document longer than the capacity is cut into full pieces, a bin each, and a
  rest that is packed like a document (pieces 0, 1, ... in order).
* A null source conflicts with other null sources; a null cluster with nothing.
  Without ``cluster_col``, documents with the same text, case and white space
  aside, are a cluster.
* Documents without an id and repeated rows are packed row by row; ties in length
  are broken by id and cluster hash.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.shared import LAST_ID, checkpointed, read_table

CAPACITY = 2048
SHARD_TOKENS = 8_000_000
SCHEMA = "doc_id long, piece int, bin_id long, position int, n_tokens int"


class Bins:
    """Open bins of one shard, ordered by what they have left."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.total = np.zeros(capacity + 1, np.int32)
        self.holding: dict[int, np.ndarray] = {}
        #: what is left -> source bitmap -> numbers of the bins, rising
        self.levels: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.left: list[int] = []

    def _bits(self, sources: int) -> Iterator[int]:
        while sources:
            low = sources & -sources
            yield low.bit_length() - 1
            sources ^= low

    def _count(self, bin_: int, by: int) -> None:
        left = self.left[bin_]
        self.total[left] += by
        for s in self._bits(self.sources[bin_]):
            self.holding[s][left] += by

    def find(self, length: int, source: int, cluster: int) -> int:
        """The tightest compatible bin, or -1."""
        holding = self.holding.get(source)
        if holding is None:
            holding = self.holding[source] = np.zeros(self.capacity + 1, np.int32)
        bit, at = 1 << source, length
        while at <= self.capacity:
            free = self.total[at:] > holding[at:]  # levels with a bin that lacks the source
            step = int(free.argmax())
            if not free[step]:
                return -1
            at += step
            best = -1
            for sources, bins in self.levels[at].items():
                if not sources & bit:
                    for b in bins:
                        if best != -1 and b > best:
                            break
                        if not self.clusters[b] & cluster:
                            best = b
                            break
            if best != -1:
                return best
            at += 1
        return -1

    def place(self, bin_: int, length: int, source: int, cluster: int) -> int:
        """Puts a document into ``bin_``, a new one if -1; the bin's number."""
        if bin_ == -1:
            bin_ = len(self.left)
            self.left.append(self.capacity)
            self.sources.append(0)
            self.clusters.append(0)
        else:
            self._count(bin_, -1)
            level = self.levels[self.left[bin_]]
            bins = level[self.sources[bin_]]
            del bins[bisect.bisect_left(bins, bin_)]
            if not bins:
                del level[self.sources[bin_]]
        self.left[bin_] -= length
        self.sources[bin_] |= 1 << source
        self.clusters[bin_] |= cluster
        if self.left[bin_]:
            if source not in self.holding:
                self.holding[source] = np.zeros(self.capacity + 1, np.int32)
            self._count(bin_, 1)
            bisect.insort(self.levels[self.left[bin_]].setdefault(self.sources[bin_], []), bin_)
        return bin_


def pack_shard(ids, lengths, sources, clusters, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (row number, piece, bin, position, tokens) for the documents of a shard.

    sources: any hashable values; clusters: hashes, None for no cluster.
    """
    numbers: dict = {}
    source = [numbers.setdefault(s, len(numbers)) for s in sources]
    seen, bits = set(), {}
    for c in clusters:
        if c is not None:
            if c in seen:
                bits.setdefault(c, 1 << len(bits))  # only clusters that meet again need a bit
            seen.add(c)
    out, bins, filled = [], Bins(capacity), []
    rests = []
    for i, n in enumerate(lengths):
        full, rest = divmod(int(n), capacity)
        for piece in range(full):
            out.append((i, piece, capacity, None))
        if rest:
            rests.append((-rest, ids[i], str(clusters[i]), i, full))
    rests.sort()
    placed = []
    for rest, _, _, i, piece in rests:
        cluster = bits.get(clusters[i], 0)
        b = bins.place(bins.find(-rest, source[i], cluster), -rest, source[i], cluster)
        if b == len(filled):
            filled.append(0)
        placed.append((i, piece, b, filled[b], -rest))
        filled[b] += 1
    first = len(bins.left)
    return placed + [(i, piece, first + k, 0, n) for k, (i, piece, n, _) in enumerate(out)]


def lengths_of(docs: DataFrame, length_col: str | None, cluster_col: str | None) -> DataFrame:
    """id, length, source, cluster of the documents that take a place."""
    length = F.col(length_col).cast("int") if length_col else F.regexp_count("text", F.lit(r"\S+"))
    plain = F.lower(F.regexp_replace("text", r"\s+", " "))
    cluster = F.xxhash64(F.col(cluster_col)) if cluster_col else F.xxhash64(plain)
    if cluster_col:
        cluster = F.when(F.col(cluster_col).isNotNull(), cluster)
    return docs.select(F.col("doc_id").cast("long").alias("id"), length.alias("length"), F.col("source").cast("string").alias("source"), cluster.alias("cluster")).filter("length > 0")


def pack(docs: DataFrame, capacity: int = CAPACITY, length_col: str | None = None, cluster_col: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Where each piece of each document goes: doc_id, piece, bin_id, position, n_tokens."""
    rows = checkpointed(lengths_of(docs, length_col, cluster_col))
    tokens = rows.agg(F.sum("length")).first()[0] or 0
    shards = max(1, -(-tokens // shard_tokens))

    def apply(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "cluster", "source"], kind="stable").reset_index(drop=True)
        clusters = [None if pd.isna(c) else int(c) for c in pdf["cluster"]]
        made = pack_shard(pdf["order"].tolist(), pdf["length"].tolist(), pdf["source"].tolist(), clusters, capacity)
        base = int(key[0]) << 32
        ids = [None if pd.isna(x) else int(x) for x in pdf["id"]]
        out = pd.DataFrame([(piece, base + b, at, n) for _, piece, b, at, n in made], columns=["piece", "bin_id", "position", "n_tokens"])
        return out.assign(doc_id=pd.array([ids[m[0]] for m in made], "Int64"))

    # the rows lie in files now, so their numbers are the same each time they are read
    dealt = rows.withColumns({"order": F.coalesce("id", F.lit(LAST_ID)), "row": F.monotonically_increasing_id()}).withColumn("shard", F.pmod(F.xxhash64("order"), F.lit(shards)))
    if shards > 1:
        # there is one row for twice SHARD_TOKENS tokens at least
        large = dealt.groupBy("shard").agg(F.ceil(F.sum("length") / shard_tokens).alias("parts")).filter("parts > 2")
        dealt = dealt.join(large, "shard", "left").withColumn("shard", F.col("shard") + shards * F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1))))
    # as strings, since pandas turns nullable longs into floats
    dealt = dealt.withColumns({"cluster": F.col("cluster").cast("string"), "id": F.col("id").cast("string")})
    return dealt.groupBy("shard").applyInPandas(apply, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
