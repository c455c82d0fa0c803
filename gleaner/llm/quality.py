"""Quality classifier: support vectors over naive-Bayes scaled n-grams.

Each document becomes the set of its word unigrams and bigrams (indicators,
hashed to ``2 ** BITS`` numbers). A bigram of a word with itself also counts as the
n-gram ``REPEAT``, whatever the word, which has a number of its own. An indicator is
scaled by the log-count ratio of its class shares, documents to length 1, and a
linear model of L2 norm and hinge loss is fitted by dual coordinate descent. Two
heads are trained on the label table: *quality* (1 good) and *toxicity* (0 good). A
document is rejected when either head rejects it.

Defined results
---------------
* Only the training set is a sample: at most ``max_train`` labelled documents,
  those with the smallest hash of their id. Scoring covers every document.
* Descent ends when no document's projected gradient is off by more than
  ``TOLERANCE``, or after ``EPOCHS``.
* A null or empty text has no feature; its score is the model's intercept.
* A null label is no label. Several labels of one document count as the worst
  (lowest quality, highest toxicity). Labelled ids that are absent are ignored,
  as are documents without an id, in training only.
* Without labels of both classes a head keeps everything (score 0).
* A repeated row is scored like any other; ties (score 0) are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.shared import read_table

BITS = 20
REPEAT = 1 << BITS
SIZE = REPEAT + 1
TOLERANCE = 0.01
EPOCHS = 1000
SMOOTHING = 16.0
MAX_TRAIN = 20_000
HEADS = ("quality", "toxic")
_TOKEN = re.compile(rb"[a-z0-9_\x80-\xff]+|[^\sa-z0-9_\x80-\xff]+")


_LAST_SEEN = np.zeros(SIZE, np.int32)


def features(text: str | None) -> np.ndarray:
    """Distinct feature numbers of a text's unigrams and bigrams."""
    if not text:
        return np.empty(0, np.uint32)
    tokens = _TOKEN.findall(text.lower().encode("utf-8", "replace"))
    words = np.fromiter(map(crc32, tokens), np.uint32, len(tokens))
    mixed = (words ^ (words >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    one = mixed >> np.uint32(32 - BITS)
    two = (mixed[:-1] * np.uint32(0x9E3779B1) + words[1:]) * np.uint32(0x85EBCA6B)
    again = np.full(1 if (words[1:] == words[:-1]).any() else 0, REPEAT, np.uint32)
    ids = np.concatenate([one, two >> np.uint32(32 - BITS), again])
    place = np.arange(len(ids), dtype=np.int32)
    _LAST_SEEN[ids] = place  # what is read back was written just now, so the table is never cleared
    return ids[_LAST_SEEN[ids] == place]


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """Log ratio of each feature's shares of the two classes.

    ``smoothing`` occurrences of every feature are added, dealt to the classes by
    their totals: a rare feature tells little, one not seen nothing, also where one
    class is much smaller.
    """
    pos, neg = np.zeros(SIZE), np.zeros(SIZE)
    for ids, label in zip(rows, y):
        (pos if label > 0 else neg)[ids] += 1
    more = smoothing / max(pos.sum() + neg.sum(), 1)
    return np.log((pos / max(pos.sum(), 1) + more) / (neg / max(neg.sum(), 1) + more))


def fit_head(rows: list[np.ndarray], y: np.ndarray, c: float = 1.0, smoothing: float = SMOOTHING, seed: int = 7, tolerance: float = TOLERANCE) -> tuple[np.ndarray, float]:
    """Weights per feature (ratios multiplied in) and intercept.

    Dual coordinate descent for the hinge loss: one dual variable per document,
    between 0 and its class's share of ``c``, visited in a new random order in every
    epoch. Variables at a bound whose gradient points out of it by more than any
    seen in the last epoch are left alone until the others have converged. Classes
    are weighted to the same total.
    """
    if len(rows) == 0 or (y > 0).all() or (y < 0).all():
        return np.zeros(SIZE, np.float32), 0.0
    ratio = log_count_ratio(rows, y, smoothing)
    norms = np.array([np.sqrt((ratio[ids] ** 2).sum() + 1.0) for ids in rows])
    scaled = [(ratio[ids] / n).astype(np.float32) for ids, n in zip(rows, norms)]
    top = c * np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    w, bias, alpha = np.zeros(SIZE), 0.0, np.zeros(len(rows))
    every, random = np.arange(len(rows)), np.random.default_rng(seed)
    active, high, low = every.copy(), np.inf, -np.inf
    for _ in range(EPOCHS):
        random.shuffle(active)
        most, least, stays = -np.inf, np.inf, np.ones(len(active), bool)
        for k, i in enumerate(active):
            ids, v, unit = rows[i], scaled[i], 1.0 / norms[i]
            gradient = y[i] * (w[ids] @ v + bias * unit) - 1
            off = gradient
            if alpha[i] == 0:
                if gradient > high:
                    stays[k] = False
                    continue
                off = min(gradient, 0.0)
            elif alpha[i] == top[i]:
                if gradient < low:
                    stays[k] = False
                    continue
                off = max(gradient, 0.0)
            most, least = max(most, off), min(least, off)
            if off:
                new = min(max(alpha[i] - gradient, 0.0), top[i])  # documents have length 1
                step = (new - alpha[i]) * y[i]
                w[ids] += step * v
                bias += step * unit
                alpha[i] = new
        done, whole = max(most, -least) <= tolerance, len(active) == len(every)
        if done and whole:
            break
        active = every.copy() if done else active[stays]
        high = most if most > 0 and not done else np.inf
        low = least if least < 0 and not done else -np.inf
    return (w * ratio).astype(np.float32), float(bias)


def training_sample(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """Texts of at most ``max_train`` labelled documents with quality and toxic."""
    one = (
        labels.select(F.col("doc_id").cast("long").alias("id"), "quality", "toxic")
        .filter("id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)")
        .groupBy("id")
        .agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_train)
    )
    # at most max_train small rows, so a broadcast of them doesn't grow with the input
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    return texts.join(F.broadcast(one), "id").select("id", "text", "quality", "toxic")


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, c: float = 1.0) -> dict[str, tuple[np.ndarray, np.ndarray, float]]:
    """Per head the feature numbers, weights and intercept.

    Features are computed where the texts are; one task fits both heads.
    """

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "ids": [features(t).tobytes() for t in b["text"]], "quality": b["quality"], "toxic": b["toxic"]})

    def fit(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "ids"]).drop_duplicates("id")
        rows, out = [np.frombuffer(x, np.uint32) for x in pdf["ids"]], []
        for head in HEADS:
            known = pdf[head].notna().to_numpy()
            good = pdf[head].fillna(0).to_numpy() > 0
            y = np.where(good if head == "quality" else ~good, 1.0, -1.0)[known]
            w, bias = fit_head([r for r, k in zip(rows, known) if k], y, c)
            ids = np.flatnonzero(w).astype(np.uint32)
            out.append((head, ids.tobytes(), w[ids].tobytes(), bias))
        return pd.DataFrame(out, columns=["head", "ids", "weights", "bias"])

    made = training_sample(docs, labels, max_train).mapInPandas(featurise, "id long, ids binary, quality double, toxic double")
    # a model has at most SIZE numbers
    models = made.groupBy(F.lit(0).alias("all")).applyInPandas(fit, "head string, ids binary, weights binary, bias double").collect()
    return {r["head"]: (np.frombuffer(r["ids"], np.uint32), np.frombuffer(r["weights"], np.float32), r["bias"]) for r in models}


def score(docs: DataFrame, model: dict, columns: list[str] | None = None) -> DataFrame:
    """``docs`` with quality_score, toxic_score (above 0 is good) and keep, which replace columns of these names."""
    from pyspark.sql import types as T

    columns = [c for c in columns or docs.columns if c not in ("quality_score", "toxic_score", "keep")]
    read = "_text" + "_" * max(map(len, columns), default=0)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([f for f in docs.select(*[F.col(f"`{c}`") for c in columns]).schema] + [T.StructField(n, t) for n, t in (("quality_score", T.DoubleType()), ("toxic_score", T.DoubleType()), ("keep", T.BooleanType()))])

    def apply(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tables = {}
        for head in HEADS:
            w, bias = np.zeros(SIZE, np.float32), 0.0
            if head in shared.value:
                ids, values, bias = shared.value[head]
                w[ids] = values
            tables[head] = (w, bias)
        for b in batches:
            found = {h: np.empty(b.num_rows) for h in HEADS}
            for i, t in enumerate(b.column(b.num_columns - 1)):
                ids = features(t.as_py())
                for h, (w, bias) in tables.items():
                    found[h][i] = float(w[ids].sum(dtype=np.float64)) + bias
            q, t = found["quality"], found["toxic"]
            kept = b.columns[:-1]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(q), pa.array(t), pa.array((q >= 0) & (t >= 0))], names=[f.name for f in schema])

    return docs.select(*[F.col(f"`{c}`") for c in columns], F.col("text").alias(read)).mapInArrow(apply, schema)


def keep_good(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of ``docs`` that neither head rejects, with their columns."""
    model = train(docs, labels, max_train)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    return score(packed, model, ["row"]).filter("keep").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are kept, with both scores."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read_table(spark, sf_dir, "labels"))
    return score(docs, model, ["doc_id"]).filter("keep").select("doc_id", F.round("quality_score", 6).alias("quality_score"), F.round("toxic_score", 6).alias("toxic_score"))
