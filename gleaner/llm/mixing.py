"""Mixing to target weights: iterative proportional fitting and sampling.

Tokens are summed by source, language and topic. Iterative proportional fitting
rakes these cell weights until their sums by source, by language and by topic meet
the targets, no cell above what there is, and no probability moves by more than
``TOLERANCE`` in a sweep. A document is then drawn with the probability of its
cell, raked tokens over present tokens, by a uniform number made from its id.

The cells are small and go to one task, not to the driver; documents meet their
cell's probability by a join on it, broadcast while the cells, which are counted,
are within ``BROADCAST_BYTES``.

Defined results
---------------
* Targets are shares of each value. Without given ones they are the present
  shares to the power ``temper``, so that large parts shrink and small ones grow.
  Values without a given target get none: their documents are not drawn. Shares
  are scaled to sum 1; a target for an absent value goes to the others.
* ``fraction`` of all tokens is drawn in expectation. A target above what there is
  of a value is cut to that, and the others take its rest in proportion.
* Targets that can be met one by one may still not be met together; then the
  weights come to rest as near as the sweeps bring them. ``marginals`` tells what
  was wanted, what was left of it after the cut, and what is reached. Sweeps end
  after ``SWEEPS`` at the latest, which shows there too.
* A null source, language or topic is a value of its own.
* The tables have no topic: it is the kind of text (``TOPIC``) unless ``topic`` is
  given. Null and empty texts have no tokens; they are drawn with probability
  ``fraction``.
* Documents without an id are all drawn by the number of the empty string; of
  repeated rows all or none are drawn. Nothing of an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.shared import checkpointed, read_table, uniform

FRACTION = 0.5
TEMPER = 0.7
SWEEPS = 20_000
TOLERANCE = 1e-12
BROADCAST_BYTES = 64 << 20
TOKENS = "CAST(ceil(octet_length(text) / 4.0) AS BIGINT)"
TOPIC = """CASE WHEN contains(lower(text), 'licen') OR contains(lower(text), 'all rights reserved') THEN 'legal'
 WHEN contains(text, ' | ') THEN 'tabular'
 WHEN contains(text, '***') OR contains(text, '!!') THEN 'noisy'
 WHEN octet_length(text) < 400 THEN 'brief' ELSE 'prose' END"""
PARTS = ("source", "lang", "topic")


def cut(present: np.ndarray, shares: np.ndarray, total: float) -> np.ndarray:
    """Goals in proportion to ``shares``, none above what is present, summing to ``total`` if there is so much."""
    wanted = shares > 0
    order = np.argsort(np.divide(present, shares, out=np.full(len(present), np.inf), where=wanted), kind="stable")[: wanted.sum()]
    goal, left, rest = np.zeros(len(present)), total, shares[order].sum()
    for k, i in enumerate(order):
        scale = left / rest
        if scale * shares[i] <= present[i]:  # and so for all that follow
            goal[order[k:]] = scale * shares[order[k:]]
            break
        goal[i] = present[i]
        left, rest = left - present[i], rest - shares[i]
    return goal


def rake(cells: pd.DataFrame, targets: dict[str, dict[str, float]], fraction: float, temper: float, sweeps: int = SWEEPS) -> tuple[np.ndarray, pd.DataFrame]:
    """Raked weights of cells with columns source, lang, topic, tokens; and the marginals."""
    tokens = cells["tokens"].to_numpy(float)
    total = fraction * tokens.sum()
    w = tokens * fraction
    goals, said = [], []
    for part in PARTS:
        codes, values = pd.factorize(cells[part])
        present = np.bincount(codes, tokens, len(values))
        shares = np.array([targets[part].get(v, 0.0) for v in values], float) if part in targets else present**temper
        goals.append((codes, goal := cut(present, shares, total)))
        wanted = shares / shares.sum() * total if shares.sum() else shares
        said.append(pd.DataFrame({"part": part, "value": values, "present": present, "wanted": wanted, "goal": goal}))
    done = 0
    while done < sweeps:
        before = w
        for codes, goal in goals:
            now = np.bincount(codes, w, len(goal))
            factor = np.divide(goal, now, out=np.zeros(len(goal)), where=now > 0)
            w = np.minimum(tokens, w * factor[codes])
        done += 1
        if (np.abs(w - before) <= TOLERANCE * tokens).all():
            break
    for table, (codes, goal) in zip(said, goals):
        table["reached"] = np.bincount(codes, w, len(goal))
    return w, pd.concat(said, ignore_index=True).assign(sweeps=done)


def cells_of(docs: DataFrame, topic: Column | None) -> DataFrame:
    return keyed(docs, topic).groupBy(*PARTS).agg(F.sum("tokens").alias("tokens"))


def probabilities(docs: DataFrame, topic: Column | None = None, targets: dict | None = None, fraction: float = FRACTION, temper: float = TEMPER) -> DataFrame:
    """source, lang, topic, tokens, probability of every cell; nulls as '\\0'."""
    targets = targets or {}

    def apply(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(PARTS)).reset_index(drop=True)
        w, _ = rake(pdf, targets, fraction, temper)
        tokens = pdf["tokens"].to_numpy(float)
        p = np.divide(w, tokens, out=np.full(len(w), fraction), where=tokens > 0)
        return pdf[[*PARTS, "tokens"]].assign(probability=p)

    return cells_of(docs, topic).groupBy(F.lit(0).alias("all")).applyInPandas(apply, "source string, lang string, topic string, tokens long, probability double")


def marginals(docs: DataFrame, topic: Column | None = None, targets: dict | None = None, fraction: float = FRACTION, temper: float = TEMPER) -> DataFrame:
    """part, value, present, wanted, goal, reached (tokens), sweeps: how near the weights come to the targets."""
    targets = targets or {}

    def apply(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return rake(pdf.sort_values(list(PARTS)).reset_index(drop=True), targets, fraction, temper)[1]

    return cells_of(docs, topic).groupBy(F.lit(0).alias("all")).applyInPandas(apply, "part string, value string, present double, wanted double, goal double, reached double, sweeps int")


def keyed(docs: DataFrame, topic: Column | None = None, *more: Column) -> DataFrame:
    """source, lang, topic (never null), tokens, and ``more``."""
    named = lambda c: F.coalesce(c.cast("string"), F.lit("\0"))
    topic = F.expr(TOPIC) if topic is None else topic
    return docs.select(named(F.col("source")).alias("source"), named(F.col("lang")).alias("lang"), named(topic).alias("topic"), F.coalesce(F.expr(TOKENS), F.lit(0)).alias("tokens"), *more)


def drawn(docs: DataFrame, topic: Column | None, targets: dict | None, fraction: float, temper: float, *more: Column) -> DataFrame:
    """source, lang, topic, tokens, probability and ``more`` of the documents that are drawn."""
    cells = checkpointed(probabilities(docs, topic, targets, fraction, temper).drop("tokens"))
    cells = F.broadcast(cells) if 256 * cells.count() <= BROADCAST_BYTES else cells
    u = uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = keyed(docs, topic, *more, u.alias("u")).join(cells, list(PARTS))
    rows = rows.withColumn("probability", F.when(F.col("tokens") > 0, F.col("probability")).otherwise(fraction))
    return rows.filter("u < probability")


def sample(docs: DataFrame, topic: Column | None = None, targets: dict | None = None, fraction: float = FRACTION, temper: float = TEMPER) -> DataFrame:
    """The rows of ``docs`` that are drawn, their columns unchanged."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return drawn(docs, topic, targets, fraction, temper, row).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn documents with the probability they were drawn with."""
    rows = drawn(read_table(spark, sf_dir, "documents"), None, None, FRACTION, TEMPER, F.col("doc_id"))
    return rows.select("doc_id", *PARTS, "tokens", F.round("probability", 6).alias("probability"))


def oracle(documents: str = "documents", sweeps: int = 2000) -> str:
    """The same in DuckDB, where sweeps go on for a fixed number of times, past their rest."""
    topic = TOPIC.replace("octet_length(text)", "strlen(text)")
    tokens = TOKENS.replace("octet_length(text)", "strlen(text)")
    steps = [
        f"""keyed AS MATERIALIZED (SELECT doc_id, coalesce(source, chr(0)) AS source, coalesce(lang, chr(0)) AS lang, {topic} AS topic, coalesce({tokens}, 0) AS tokens,
   ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM {documents})""",
        "cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM keyed GROUP BY ALL)",
        f"total AS MATERIALIZED (SELECT {FRACTION} * sum(tokens) AS t FROM cells)",
    ]
    for p in PARTS:
        # a value is cut if its goal at the scale of those not smaller is above what there is
        steps += [
            f"at_{p} AS (SELECT {p}, t, pow(t, {TEMPER}) AS share, pow(t, {1 - TEMPER:g}) AS limit_, row_number() OVER (ORDER BY t, {p}) AS k FROM (SELECT {p}, sum(tokens) AS t FROM cells GROUP BY {p}) WHERE t > 0)",
            f"scales_{p} AS (SELECT *, ((SELECT t FROM total) - coalesce(sum(t) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(share) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale FROM at_{p})",
            f"goal_{p} AS MATERIALIZED (SELECT {p}, least(t, share * (SELECT min_by(scale, k) FROM scales_{p} WHERE scale <= limit_)) AS g_{p} FROM at_{p})",
        ]
    joined = " ".join(f"LEFT JOIN goal_{p} USING ({p})" for p in PARTS)
    goals = ", ".join(f"coalesce(g_{p}, 0) AS g_{p}" for p in PARTS)
    inner = "raked"
    for p in PARTS:
        now = f"sum(w) OVER (PARTITION BY {p})"
        inner = f"(SELECT * EXCLUDE (w), least(tokens, CASE WHEN {now} > 0 THEN w * (g_{p} / {now}) ELSE 0 END) AS w FROM {inner})"
    steps.append(f"""raked AS (SELECT 0 AS step, source, lang, topic, tokens, {goals}, tokens * {FRACTION} AS w FROM cells {joined}
  UNION ALL SELECT step + 1, source, lang, topic, tokens, g_source, g_lang, g_topic, w FROM {inner} WHERE step < {sweeps})""")
    last = f"p AS (SELECT source, lang, topic, w / tokens AS p FROM raked WHERE step = {sweeps} AND tokens > 0)"
    return f"""WITH RECURSIVE {', '.join([*steps, last])}, found AS (SELECT doc_id, source, lang, topic, tokens, u, CASE WHEN tokens > 0 THEN p ELSE {FRACTION} END AS probability FROM keyed LEFT JOIN p USING (source, lang, topic))
SELECT doc_id, source, lang, topic, tokens, round(probability, 6) AS probability FROM found WHERE u < probability"""


SQL = oracle()
