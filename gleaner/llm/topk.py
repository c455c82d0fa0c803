"""Exact top-k search by Fagin's threshold algorithm.

A query is a vector of the table: its ``k`` neighbours of largest inner product
among all others. ``asks`` says which rows are queries; the registered query takes
every row whose id is divisible by 20. Vectors are dealt into shards; a shard has,
for each dimension, its rows sorted by value.
Going down these lists (from the other end where a query's weight is negative),
every row met in a list is scored in full, and the bound is the score that a row
not met yet could have at best: the sum of weight times value at the current
depth. A query stops when the bound cannot beat its k-th result, at depth 0 if a
whole shard is out of reach. Depth grows by a factor and a block of queries goes
down together, so that scores are matrix products; what one query of the block
meets, the others may score too, which only raises their k-th result.

On vectors without structure in their dimensions the bound falls late and most
rows are scored; the answer is exact on any. Pairs of a shard of queries and one of
vectors are the unit of work: they are dealt over tasks, a task holding ``GROUP``
shards that ask and ``GROUP`` that answer, so memory doesn't depend on the number
of vectors. Work is the number of queries times that of vectors.

Defined results
---------------
* Rows with a null id, a null or empty vector, or one with a null, NaN or infinite
  element are left out. Of rows with the same id the smallest vector counts.
* Vectors of unlike length are not compared. A vector is no neighbour of itself.
* Scores are compared rounded to 9 digits; ties go to the smaller id. With fewer
  than ``k`` others there are fewer rows. An empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.shared import checkpointed, read_table

K = 10
SHARD_ROWS = 2048
GROUP = 4
_TIE = 2e-9


def descend(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, names: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray], start: int = 16, factor: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """``best`` (scores, neighbours; rows sorted) after one shard.

    queries: q x d with their ids; vectors: n x d with their names.
    """
    scores, found = best
    n, d = vectors.shape
    lists = np.argsort(-vectors, axis=0, kind="stable")
    values = np.take_along_axis(vectors, lists, axis=0)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    met = np.zeros(n, bool)
    active = np.arange(len(queries))
    depth = 0
    while True:
        at = min(depth, n - 1)
        bound = up[active] @ values[at] + down[active] @ values[n - 1 - at]
        active = active[bound >= scores[active, -1] - _TIE]
        if depth >= n or not len(active):
            return scores, found
        depth = min(n, max(start, depth * factor))
        seen = np.zeros(n, bool)
        seen[lists[:depth].ravel()] = True
        seen[lists[n - depth :].ravel()] = True
        new = np.flatnonzero(seen & ~met)
        met |= seen
        if not len(new):
            continue
        got = queries[active] @ vectors[new].T
        got[ids[active][:, None] == names[new][None, :]] = -np.inf
        for j, a in enumerate(active):
            row = got[j]
            near = np.flatnonzero(row >= scores[a, -1] - _TIE)
            if not len(near):
                continue
            if len(near) > 4 * k:
                near = near[row[near] >= np.partition(row[near], -k)[-k] - _TIE]
            s = np.concatenate([scores[a], row[near]])
            f = np.concatenate([found[a], names[new[near]]])
            order = np.lexsort((f, -np.round(s, 9)))[:k]
            scores[a], found[a] = s[order], f[order]


def element(vectors: DataFrame, vector_col: str) -> type:
    """What a vector's elements travel as; scores are sums of doubles in any case."""
    return np.float32 if dict(vectors.dtypes)[vector_col] == "array<float>" else np.float64


def sound_rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v, dims of the vectors that can be compared, one per id."""
    plain = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = "id IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    return plain.filter(sound).groupBy("id").agg(F.min("v").alias("v")).select("id", "v", F.size("v").alias("dims"))


def packed_shards(rows: DataFrame, kind: type, shard_rows: int) -> tuple[DataFrame, int]:
    """One row per shard and length: shard, dims, ids, rows (binary)."""
    shards = max(1, -(-rows.count() // shard_rows))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        return pd.DataFrame({"shard": [key[0]], "dims": [key[1]], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "rows": [np.stack(pdf["v"].to_numpy()).astype(kind).tobytes()]})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    return checkpointed(dealt.groupBy("shard", "dims").applyInPandas(pack, "shard int, dims int, ids binary, rows binary")), shards


def topk(vectors: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, asks: str = "true") -> DataFrame:
    """query_id, rank (from 1), neighbor_id, score; queries are the rows with ``asks`` (SQL over ``id``)."""
    rows, kind = checkpointed(sound_rows(vectors, id_col, vector_col)), element(vectors, vector_col)
    packs, shards = packed_shards(rows, kind, shard_rows)
    asking, ask_shards = packed_shards(rows.filter(asks), kind, shard_rows)
    groups, ask_groups = -(-shards // GROUP), -(-ask_shards // GROUP)

    def search(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        dims, out = int(key[2]), []
        read = lambda r: (np.frombuffer(r["ids"], np.int64), np.frombuffer(r["rows"], kind).astype(np.float64).reshape(-1, dims))
        pdf = pdf.sort_values("shard")
        others = pdf[~pdf["asks"]]
        for _, asked in pdf[pdf["asks"]].iterrows():
            ids, queries = read(asked)
            best = np.full((len(ids), k), -np.inf), np.full((len(ids), k), -1, np.int64)
            for _, r in others.iterrows():
                names, rows = read(r)
                best = descend(queries, ids, rows, names, k, best)
            scores, found = best
            real = np.isfinite(scores)
            out.append(pd.DataFrame({"query_id": np.repeat(ids, k)[real.ravel()], "neighbor_id": found[real], "score": scores[real]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "neighbor_id": [], "score": []}).astype({"query_id": "int64", "neighbor_id": "int64"})

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = (F.col("shard") / F.lit(GROUP)).cast("int")
    asked = asking.select(own.alias("block"), every(groups).alias("part"), "dims", F.lit(True).alias("asks"), "shard", "ids", "rows")
    told = packs.select(every(ask_groups).alias("block"), own.alias("part"), "dims", F.lit(False).alias("asks"), "shard", "ids", "rows")
    found = asked.unionByName(told).groupBy("block", "part", "dims").applyInPandas(search, "query_id long, neighbor_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "neighbor_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", F.round("score", 6).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest neighbours, among all vectors, of every vector whose id is divisible by 20."""
    return topk(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), asks="id % 20 = 0")


SQL = f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, list_inner_product(a.e, b.e) AS s FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, neighbor_id))::INT AS rank FROM pairs)
SELECT query_id, rank, neighbor_id, round(s, 6) AS score FROM ranked WHERE rank <= {K}
"""
