"""N-gram Jaccard join by chosen paths.

A document is the set of its word ``n``-grams (lower case, split at white space).
A MinHash signature of ``WIDTH`` positions turns every set into one of fixed size
in which the share of equal positions estimates the Jaccard similarity. The join
then splits recursively: a node of the tree draws a few positions, and each
document goes down to the child named by its value there, so that similar
documents stay together. Buckets of at most ``LEAF`` documents are compared pair
by pair. In larger ones, documents that resemble the whole bucket (copies that no
split can part) are compared with all of it and leave; the rest is split further.
So many positions are drawn that the share of pairs at the threshold that stay
together doesn't fall with the depth (``survival``), and as many runs with other
positions are made as the target recall needs. Candidates are then verified
exactly on the n-gram sets.

Large clusters of near copies don't go down. Samples of the buckets above ``LEAF``
name centres; the sets that agree with a centre to the threshold are its ball
(``balls``). All sets of a ball are compared exactly with one another, in blocks
that meet two by two, by products of 0/1 matrices; of these pairs only the sums and
the components of each two blocks leave the task. Elsewhere two of one ball are no
candidates, and a ball that fills more than half of a large bucket is compared with
the rest of it and leaves.

The first levels of the tree are exchanges, the rest of a subtree runs inside one
task. A bucket of more than ``HOT`` documents is split by another exchange, at
most ``LEVELS`` times; what is as large then resembles itself, and its blocks of
``HOT`` documents meet two by two. So no task holds more than two blocks, or more
than ``PAIRS`` pairs. Only signatures travel, texts of candidate documents and of
balls excepted.

Defined results
---------------
* A text of fewer than ``n`` words is one n-gram, all its words. Null texts and
  texts without a word have no set and pair with nothing.
* Documents without an id are left out. Several rows of one id with unlike texts
  are several sets of one document, never paired with one another; equal rows are
  one.
* ``classes``, which the query returns, has one row per id: the class (the
  smallest id that a chain of similar documents leads to; its own without any) and
  the number of links. Links are counted by sets: for each set of the document,
  the other documents with the same set and the documents of every similar set.
* ``jaccard_join`` has the pairs of unlike sets, between the documents of smallest
  id that have them, and pairs of similarity 1 between such a document and the
  others of its set: all links, copies not unfolded.
* A pair is reported once, ``doc_id_a`` < ``doc_id_b``, if its similarity is at
  least ``threshold`` (ties are reported).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from gleaner.llm.shared import checkpointed, ensure_checkpoint_dir, read_table

WIDTH = 128
LEAF = 256
#: Signature estimates may fall short of the threshold by so much, 2.7 standard deviations at 0.5.
MARGIN = 0.12
#: Above so many bytes of ids, candidate documents are found by a shuffled join.
BROADCAST_BYTES = 64 << 20
#: Documents of a bucket that one task may hold; twice as many where blocks meet.
HOT = 4096
#: Up to so many edges, 16 MB, one task joins them; the result is the same.
FEW_EDGES = 1_000_000
LEVELS = 3
#: Candidate pairs that a task gathers before it passes them on.
PAIRS = 1 << 18
#: Documents of a bucket, about, that its centres are drawn from, and buckets that have any, the largest first; other documents go down the tree.
SAMPLE = 64
CENTRED = 8192
#: Sets and n-grams of a ball's block, and ends of pairs whose sets are held side by side.
BLOCK_SETS = 1024
BLOCK_GRAMS = 1 << 19
ENDS = 1024

_random = np.random.default_rng(20240229)
_MULTIPLY = (_random.integers(0, 1 << 31, WIDTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_ADD = _random.integers(0, 1 << 32, WIDTH, dtype=np.uint64).astype(np.uint32)[:, None]


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams."""
    words = text.lower().encode("utf-8", "replace").split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(n, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def identity(hashes: np.ndarray) -> bytes:
    """What tells a set that isn't empty from others."""
    return mix64(np.array([len(hashes), hashes.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix64(hashes))], np.uint64)).tobytes()


def signature(hashes: np.ndarray) -> np.ndarray:
    """MinHash values, 32 bits each, of a set that isn't empty."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(WIDTH, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 4096):
        np.minimum(least, (low[i : i + 4096] * _MULTIPLY + _ADD).min(axis=1), out=least)
    return least


def branches(threshold: float) -> int:
    """Positions drawn at a node: one more than keep a pair at the threshold together on the average."""
    return math.ceil(1 / threshold) + 1


def survival(threshold: float) -> float:
    """The chance that a pair at the threshold meets in a leaf, at any depth.

    It does if one of the drawn positions agrees and it does so below: the fixed
    point of p = 1 - (1 - threshold p) ** branches, to which p falls with the depth.
    """
    p = 1.0
    for _ in range(200):
        p = 1 - (1 - threshold * p) ** branches(threshold)
    return p


def runs_for(threshold: float, recall: float) -> int:
    """Runs after which a pair at the threshold is found with ``recall``."""
    p = survival(threshold)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - p))) if p < 1 else 1


def similar_in(values: np.ndarray, rows: np.ndarray, others: np.ndarray, least: float, ball: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ``rows`` and ``others``, position by position, not of one ball, whose signatures agree enough."""
    if ball is not None:
        apart = (ball[rows] != ball[others]) | (ball[rows] == 0)
        rows, others = rows[apart], others[apart]
    found = []
    for i in range(0, len(rows), 16384):
        agree = np.count_nonzero(values[rows[i : i + 16384]] == values[others[i : i + 16384]], axis=1)
        found.append(agree >= least * WIDTH)
    keep = np.concatenate(found) if found else np.empty(0, bool)
    return rows[keep], others[keep]


Pairs = Iterator[tuple[np.ndarray, np.ndarray]]


def each_other(values: np.ndarray, rows: np.ndarray, least: float, ball: np.ndarray | None = None) -> Pairs:
    """Similar pairs among ``rows``, compared pair by pair."""
    for lag in range(1, len(rows)):
        yield similar_in(values, rows[:-lag], rows[lag:], least, ball)


def across(values: np.ndarray, rows: np.ndarray, others: np.ndarray, least: float, ball: np.ndarray | None = None) -> Pairs:
    """Similar pairs of one of ``rows`` and one of ``others``."""
    few, many = sorted((rows, others), key=len)
    for row in few:
        yield similar_in(values, np.full(len(many), row), many, least, ball)


def join_bucket(values: np.ndarray, rows: np.ndarray, least: float, fanout: int, seed: int, depth: int = 0, ball: np.ndarray | None = None) -> Pairs:
    """Candidate pairs (row numbers) in one bucket, by recursion."""
    n = len(rows)
    if n < 2:
        return
    if n <= LEAF:
        yield from each_other(values, rows, least, ball)
        return
    if ball is not None:
        balls, counts = np.unique(ball[rows], return_counts=True)
        most = counts.argmax()
        if balls[most] and 2 * counts[most] > n:  # its own pairs are found elsewhere
            own = ball[rows] == balls[most]
            yield from across(values, rows[own], rows[~own], least, ball)
            yield from join_bucket(values, rows[~own], least, fanout, seed, depth + 1, ball)
            return
    own = values[rows]
    close = np.zeros(n)
    for i in range(WIDTH):
        _, inverse, counts = np.unique(own[:, i], return_inverse=True, return_counts=True)
        close += counts[inverse] - 1
    near = close / (WIDTH * (n - 1)) >= least
    if near.any():
        far = rows[~near]
        for k, row in enumerate(rows[near]):
            rest = np.concatenate([rows[near][k + 1 :], far])
            yield similar_in(values, np.full(len(rest), row), rest, least, ball)
        rows = far
        if len(rows) <= LEAF:
            yield from join_bucket(values, rows, least, fanout, seed, depth + 1, ball)
            return
    for i in np.random.default_rng([seed, depth]).choice(WIDTH, fanout, replace=False):
        order = np.argsort(values[rows, i], kind="stable")
        cuts = np.flatnonzero(np.diff(values[rows[order], i])) + 1
        for part in np.split(rows[order], cuts):
            if len(part) == len(rows):  # nothing parts them here
                yield from each_other(values, part, least, ball)
                return
            yield from join_bucket(values, part, least, fanout, (seed * 1000003 + int(i) * 65537 + int(values[part[0], i])) & 0x7FFFFFFF, depth + 1, ball)


def signatures(docs: DataFrame, n: int, threshold: float, recall: float) -> DataFrame:
    """One row per set: its document, what tells it from others, number of n-grams, MinHash values, buckets."""
    fanout = branches(threshold)
    runs = runs_for(threshold, recall)
    places = np.stack([np.random.default_rng([r, 99]).choice(WIDTH, fanout, replace=False) for r in range(runs)])
    salt = mix64(np.arange(1, runs * fanout + 1, dtype=np.uint64))

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for id_, text in zip(b["id"], b["text"]):
                s = shingles(text, n)
                if len(s):
                    v = signature(s)
                    buckets = mix64(v[places.ravel()].astype(np.uint64) ^ salt)
                    out.append((id_, identity(s), len(s), (v & np.uint32(0xFFFF)).astype(np.uint16).tobytes(), buckets.view(np.int64).tolist()))
            yield pd.DataFrame(out, columns=["id", "whole", "grams", "values", "buckets"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter("id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInPandas(sketch, "id long, whole binary, grams int, values binary, buckets array<long>")


def _sent(df: DataFrame, many: int, width: int) -> DataFrame:
    """``df`` of ``many`` rows, broadcast where that is little."""
    return F.broadcast(df) if width * many <= BROADCAST_BYTES else df


def _buckets(rows: DataFrame, least: int) -> DataFrame:
    """bucket, many of the buckets of more than ``least`` rows."""
    return checkpointed(rows.groupBy("bucket").agg(F.count("*").alias("many")).filter(F.col("many") > least))


def centres(values: np.ndarray, threshold: float) -> list[np.ndarray]:
    """Most frequent values of the largest neighbourhoods in a sample of signatures, each an eighth of it at least."""
    out, left, least = [], values, max(2, len(values) / 8)
    while len(left) >= least:
        near = np.stack([np.count_nonzero(left == v, axis=1) for v in left]) >= threshold * WIDTH
        own = near[near.sum(axis=1).argmax()]
        if own.sum() < least:
            break
        out.append(np.array([(u := np.unique(c, return_counts=True))[0][u[1].argmax()] for c in left[own].T], np.uint16))
        left = left[~own]
    return out


def balls(made: DataFrame, sets: DataFrame, counts: DataFrame, threshold: float) -> DataFrame | None:
    """id, whole, grams, ball, block, blocks of the sets near a centre; None without any.

    Sets of documents that have several belong to no ball.
    """
    many = counts.count()
    if not many:
        return None

    def drawn(sample: pd.DataFrame) -> pd.DataFrame:
        found = centres(np.frombuffer(b"".join(sample["values"]), np.uint16).reshape(-1, WIDTH), threshold)
        return pd.DataFrame({"bucket": sample["bucket"].iloc[0], "many": sample["many"].iloc[0], "centre": [c.tobytes() for c in found]})

    named = sets.select("id", "values", F.explode("buckets").alias("bucket")).join(_sent(counts, many, 16), "bucket")
    sample = named.filter(F.pmod(F.xxhash64("id", "bucket"), F.ceil(F.col("many") / SAMPLE)) == 0)
    found = sample.groupBy("bucket").applyInPandas(drawn, "bucket long, many long, centre binary").orderBy(F.desc("many"), "bucket", "centre").limit(CENTRED).collect()
    leaders, by = np.empty((len(found), WIDTH), np.uint16), {}
    last = 0
    for r in found:
        centre = np.frombuffer(r["centre"], np.uint16)
        agree = np.count_nonzero(leaders[:last] == centre, axis=1)
        if not last or agree.max() < threshold * WIDTH:
            leaders[last] = centre
            k = last = last + 1
        else:
            k = int(agree.argmax()) + 1
        by.setdefault(r["bucket"], set()).add(k)
    if not last:
        return None
    leaders, keys = leaders[:last].copy(), np.array(sorted(by), np.int64)
    options = np.zeros((len(keys), max(map(len, by.values()))), np.int64)
    for place, key in enumerate(keys.tolist()):
        options[place, : len(by[key])] = sorted(by[key])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            row = np.repeat(np.arange(len(b)), [len(x) for x in b["buckets"]])
            bucket = np.concatenate(b["buckets"].to_list())
            at = np.minimum(np.searchsorted(keys, bucket), len(keys) - 1)
            hit = keys[at] == bucket
            tried = np.stack([np.repeat(row[hit], options.shape[1]), options[at[hit]].ravel()], axis=1)
            row, ball = np.unique(tried[tried[:, 1] > 0], axis=0).T
            own, place = np.unique(row, return_inverse=True)
            values = np.frombuffer(b"".join(b["values"].iloc[own]), np.uint16).reshape(-1, WIDTH)
            agree = np.array([np.count_nonzero(values[p] == leaders[k - 1]) for p, k in zip(place, ball)], int)
            order = np.lexsort((ball, -agree, row))
            order = order[agree[order] >= threshold * WIDTH]
            order = order[np.unique(row[order], return_index=True)[1]]
            yield b.iloc[row[order]][["id", "whole", "grams"]].assign(ball=ball[order])

    near = sets.select("id", "whole", "grams", "values", "buckets").mapInPandas(assign, "id long, whole binary, grams int, ball long")
    several = checkpointed(made.groupBy("id").agg(F.min("whole").alias("one"), F.max("whole").alias("other")).filter("one <> other").select("id"))
    near = near.join(_sent(several, several.count(), 24), "id", "left_anti")
    order = Window.partitionBy("ball").orderBy("id")
    block = F.floor((F.row_number().over(order) - 1) / BLOCK_SETS) + F.floor(F.sum("grams").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) / BLOCK_GRAMS)
    placed = near.withColumn("block", block.cast("int"))
    return checkpointed(placed.withColumn("blocks", F.max("block").over(Window.partitionBy("ball")) + 1))


def shared(ones: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """How many hashes each of ``ones`` has in common with each of ``others``.

    Frequent hashes are columns of 0/1 matrices that are multiplied; of the rest each
    two places are counted.
    """
    n, m, count = len(ones), len(others), lambda sets: np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    column = np.unique(np.concatenate([*ones, *others]), return_inverse=True)[1]
    row, other = count(ones), count(others)
    col, other_col = column[: len(row)], column[len(row) :]
    width = int(column.max(initial=-1)) + 1
    one_many, other_many = np.bincount(col, minlength=width), np.bincount(other_col, minlength=width)
    met = one_many * other_many
    out = np.zeros((n, m), np.float32)
    dense = np.flatnonzero(met * 100 > n * m)
    for i in range(0, len(dense), 1024):
        place = np.full(width, -1)
        place[dense[i : i + 1024]] = np.arange(len(dense[i : i + 1024]))
        tiles = []
        for rows, cols, size in ((row, col, n), (other, other_col, m)):
            tiles.append(np.zeros((size, len(dense[i : i + 1024])), np.float32))
            on = place[cols] >= 0
            tiles[-1][rows[on], place[cols[on]]] = 1
        out += tiles[0] @ tiles[1].T
    rare = (met > 0) & (met * 100 <= n * m)
    row, col = row[rare[col]], col[rare[col]]
    by = np.argsort(other_col, kind="stable")
    start, other = np.cumsum(other_many) - other_many, other[by]
    ends = np.cumsum(other_many[col])
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20), "right")))
        times = other_many[col[at:to]]
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        np.add.at(out, (np.repeat(row[at:to], times), other[np.repeat(start[col[at:to]], times) + step]), 1)
        at = to
    return out


def roots(linked: np.ndarray) -> np.ndarray:
    """The first row of each row's component; ``linked`` is symmetric."""
    root = np.full(len(linked), -1)
    for start in range(len(linked)):
        front = np.array([start] if root[start] < 0 else [], int)
        while len(front):
            root[front] = start
            front = np.flatnonzero(linked[front].any(axis=0) & (root < 0))
    return root


def inside_balls(placed: DataFrame, docs: DataFrame, n: int, threshold: float, pairs: bool = False) -> DataFrame:
    """All similar pairs of two sets of a ball, found exactly; ``placed`` may have a ``size`` for each set.

    a, b, jaccard if ``pairs``; else for each set and two blocks in which it has
    similar sets whole, id, links (the sum of their sizes), root (the smallest id
    connected to it there).
    """
    wanted = placed if "size" in placed.columns else placed.withColumn("size", F.lit(1).cast("long"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter("text IS NOT NULL").join(_sent(wanted, wanted.count(), 64), "id")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.drop(columns="text").assign(members=[shingles(t, n).tobytes() for t in b["text"]])

    members = texts.select("id", "whole", "size", "ball", "block", "blocks", "text").mapInPandas(sets, "id long, whole binary, size long, ball long, block int, blocks int, members binary")
    met = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})

    def compared_blocks(held: dict[int, dict[bytes, tuple]], low: int, high: int) -> Iterator[pd.DataFrame]:
        if low not in held or high not in held:
            return
        one, other = (sorted((*x, w) for w, x in held[k].items()) for k in (low, high))
        x, y = ([np.frombuffer(r[2], np.uint64) for r in side] for side in (one, other))
        common = shared(x, y)
        found = np.zeros(common.shape, bool)
        lengths, other_lengths = np.array([len(s) for s in x], float), np.array([len(s) for s in y], float)
        for i in range(0, len(x), 128):
            part = common[i : i + 128].astype(float)
            found[i : i + 128] = part / (lengths[i : i + 128, None] + other_lengths - part) >= threshold
        if low == high:
            np.fill_diagonal(found, False)
        if pairs:
            for i in range(len(x)):
                k = np.flatnonzero(found[i])
                k = k[k > i] if low == high else k
                ids = np.array([other[j][0] for j in k], np.int64)
                both = common[i, k].astype(float)
                yield pd.DataFrame({"a": np.minimum(one[i][0], ids), "b": np.maximum(one[i][0], ids), "jaccard": both / (lengths[i] + other_lengths[k] - both)})
            return
        if low == high:
            rows, linked = one, found
        else:
            rows, linked = one + other, np.zeros((len(x) + len(y),) * 2, bool)
            linked[: len(x), len(x) :], linked[len(x) :, : len(x)] = found, found.T
            order = sorted(range(len(rows)), key=lambda i: rows[i][0])
            rows, linked = [rows[i] for i in order], linked[np.ix_(order, order)]
        links = linked @ np.array([r[1] for r in rows], np.int64)
        root = roots(linked)
        yield pd.DataFrame([(rows[i][3], rows[i][0], links[i], rows[root[i]][0]) for i in np.flatnonzero(links)], columns=["whole", "id", "links", "root"])

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of two blocks come together."""
        last, held = None, {}
        for b in batches:
            for ball, low, high, block, whole, id_, size, blob in zip(*(b[c] for c in ("ball", "low", "high", "block", "whole", "id", "size", "members"))):
                if (ball, low, high) != last:
                    if last:
                        yield from compared_blocks(held, *last[1:])
                    last, held = (ball, low, high), {}
                held.setdefault(block, {})[whole] = (id_, size, blob)
        if last:
            yield from compared_blocks(held, *last[1:])

    kind = "a long, b long, jaccard double" if pairs else "whole binary, id long, links long, root long"
    return met.repartition("ball", "low", "high").sortWithinPartitions("ball", "low", "high").mapInPandas(meet, kind)


def split(sets: DataFrame, fanout: int, counts: DataFrame | None = None) -> DataFrame:
    """id, values, ball, bucket, side: the first levels of the tree, no bucket above two blocks of ``HOT``.

    Children of a large bucket are named by its number and a value at positions
    drawn by that number. Rows of side 1 are to meet those of side 2, rows of side 3
    one another, all without a further split. counts: many of each bucket above ``HOT``
    at least.
    """
    balls = "ball" in sets.columns
    left, done = sets.select("id", "values", *(["ball"] if balls else [F.lit(0).cast("long").alias("ball")]), F.explode("buckets").alias("bucket")), []
    named = lambda rows, *key, side: rows.select("id", "values", "ball", F.xxhash64("bucket", *key).alias("bucket"), side.alias("side"))
    for level in range(LEVELS + 1):
        large = counts.filter(F.col("many") > HOT) if counts is not None and not level else _buckets(left, HOT)
        whole = F.lit(0).alias("side")
        if not (many := large.count()):
            return _all([*done, left.select("*", whole)])
        large = _sent(large, many, 16)
        done.append(left.join(large, "bucket", "left_anti").select("id", "values", "ball", "bucket", whole))
        left = left.join(large, "bucket")
        if balls:  # one that fills more than half of a bucket meets the rest and leaves
            ruled = checkpointed(left.filter("ball > 0").groupBy("bucket", F.col("ball").alias("ruler"), "many").agg(F.count("*").alias("own")).filter("2 * own > many").drop("many"))
            left = left.join(_sent(ruled, ruled.count(), 24), "bucket", "left")
            at = lambda size: F.ceil(size / HOT).cast("int")
            blocks, rest = at(F.col("own")), at(F.col("many") - F.col("own"))
            place = lambda size: F.pmod(F.xxhash64("id", F.lit(1)), size)
            all_of = lambda size: F.explode(F.sequence(F.lit(0), size - 1)).alias("other")
            meeting = left.filter("many > own")
            ruling = meeting.filter("ball = ruler").select("*", place(blocks).alias("k"), all_of(rest))
            ruled_by = meeting.filter("ball <> ruler").select("*", place(rest).alias("k"), all_of(blocks))
            done += [named(ruling, F.lit("ball"), "k", "other", side=F.lit(1)), named(ruled_by, F.lit("ball"), "other", F.col("k"), side=F.lit(2))]
            left = left.filter("ruler IS NULL OR ball <> ruler").select("id", "values", "ball", "bucket", (F.col("many") - F.coalesce("own", F.lit(0))).alias("many"))
        if level < LEVELS:
            place = lambda k: F.pmod(F.xxhash64("bucket", F.lit(k)), F.lit(WIDTH)).cast("int")
            child = F.array(*[F.xxhash64("bucket", F.lit(k), F.substring(F.col("values"), 2 * place(k) + 1, F.lit(2))) for k in range(fanout)])
            left = left.select("id", "values", "ball", F.explode(F.array_distinct(child)).alias("bucket"))
    blocks = F.ceil(F.col("many") / HOT).cast("int")
    own = left.withColumns({"blocks": blocks, "own": F.pmod(F.xxhash64("id"), blocks).cast("int")})
    met = own.select("id", "values", "ball", "bucket", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return _all([*done, named(met, F.least("own", "other"), F.greatest("own", "other"), side=F.expr("CASE WHEN own < other THEN 1 WHEN own > other THEN 2 ELSE 3 END"))])


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def candidates(sets: DataFrame, threshold: float, counts: DataFrame | None = None) -> DataFrame:
    """Candidate pairs (a, b) of representatives with a bucket that holds both."""
    least, fanout = max(threshold - MARGIN, 1 / WIDTH), branches(threshold)

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Buckets come sorted; the last one of a batch may go on in the next."""
        held: list[pd.DataFrame] = []

        def met(ids: np.ndarray, values: np.ndarray, bucket: np.ndarray, ball: np.ndarray, side: np.ndarray) -> Pairs:
            starts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1])
            sizes = np.diff(np.concatenate([starts, [len(ids)]]))
            rows = np.arange(len(ids))
            small = np.repeat(sizes, sizes)
            lag = 1
            left = rows[small <= LEAF]
            while len(left):  # all small buckets at once: each row with the row lag places on
                left = left[left + lag < len(ids)]
                left = left[bucket[left] == bucket[left + lag]]
                yield similar_in(values, left, left + lag, least, ball)
                lag += 1
            for start, size in zip(starts[sizes > LEAF], sizes[sizes > LEAF]):
                own = rows[start : start + size]
                if side[start] == 0:
                    yield from join_bucket(values, own, least, fanout, int(bucket[start]) & 0x7FFFFFFF, ball=ball)
                elif side[start] == 3:
                    yield from each_other(values, own, least, ball)
                else:
                    yield from across(values, own[side[own] == 1], own[side[own] == 2], least, ball)

        def joined(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
            ids, bucket = pdf["id"].to_numpy(), pdf["bucket"].to_numpy()
            values = np.frombuffer(b"".join(pdf["values"]), np.uint16).reshape(-1, WIDTH)
            pairs, many = [], 0

            def gathered() -> pd.DataFrame:
                a, b = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
                return pd.DataFrame({"a": np.minimum(ids[a], ids[b]), "b": np.maximum(ids[a], ids[b]), "bucket": bucket[a]}).drop_duplicates(["a", "b"])

            for found in met(ids, values, bucket, pdf["ball"].to_numpy(), pdf["side"].to_numpy()):
                if len(found[0]):
                    pairs.append(found)
                    many += len(found[0])
                if many >= PAIRS:
                    yield gathered()
                    pairs, many = [], 0
            if pairs:
                yield gathered()

        for b in batches:
            if not len(b):
                continue
            last = b["bucket"].iloc[-1]
            if held and b["bucket"].iloc[0] == last and held[0]["bucket"].iloc[0] == last:
                held.append(b)
                continue
            whole = b[b["bucket"] != last]
            ready = pd.concat([*held, whole], ignore_index=True)
            held = [b[b["bucket"] == last]]
            if len(ready):
                if ready["bucket"].iloc[-1] == last:
                    held.insert(0, ready[ready["bucket"] == last])
                    ready = ready[ready["bucket"] != last]
                if len(ready):
                    yield from joined(ready)
        if held:
            yield from joined(pd.concat(held, ignore_index=True))

    rows = split(sets, fanout, counts)
    met = rows.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(inside, "a long, b long, bucket long")
    return met.groupBy("a", "b").agg(F.min("bucket").alias("bucket"))


def _parted(pairs: DataFrame) -> DataFrame:
    """``pairs`` (checkpointed), those of a bucket of many ends under numbers of their own by parts of its ends."""
    large = checkpointed(pairs.groupBy("bucket").agg(F.count("*").alias("many")).filter(F.col("many") > ENDS).select("bucket"))
    if not (many := large.count()):
        return pairs
    ends = pairs.join(_sent(large, many, 16), "bucket").select("bucket", F.explode(F.array("a", "b")).alias("id")).distinct()
    parts = checkpointed(ends.groupBy("bucket").agg(F.ceil(F.count("*") * 2 / ENDS).cast("int").alias("parts")).filter("parts > 2"))
    part = lambda c: F.pmod(F.xxhash64(c), F.col("parts"))
    name = F.when(F.col("parts").isNull(), F.col("bucket")).otherwise(F.xxhash64("bucket", part("a"), part("b")))
    return pairs.join(_sent(parts, parts.count(), 16), "bucket", "left").select("a", "b", name.alias("bucket"))


def verified(pairs: DataFrame, docs: DataFrame, n: int, threshold: float) -> DataFrame:
    """Exact similarity of candidate pairs (a, b, bucket), each inside its bucket.

    One row for each pair of unlike sets of the two ids: a, b, whole_a, whole_b, jaccard.
    """
    pairs = _parted(pairs)
    ends = pairs.select("bucket", F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = checkpointed(ends.groupBy("id").agg(F.collect_list("bucket").alias("in_buckets")))
    many = wanted.agg(F.sum(F.size("in_buckets") + 4)).first()[0] or 0
    if 24 * many <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter("text IS NOT NULL").join(wanted, "id")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "in_buckets": b["in_buckets"], "members": [shingles(t, n).tobytes() for t in b["text"]]})

    members = texts.mapInPandas(sets, "id long, in_buckets array<long>, members binary")
    members = members.select("id", "members", F.explode("in_buckets").alias("bucket"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of a bucket come together: first its sets, then its pairs."""
        bucket, held = None, {}
        for batch in batches:
            out = []
            for key, kind, a, b, blob in zip(batch["bucket"], batch["kind"], batch["a"], batch["b"], batch["members"]):
                if key != bucket:
                    bucket, held = key, {}
                if kind == 0:
                    s = np.frombuffer(blob, np.uint64)
                    if len(s):
                        held.setdefault(a, {})[identity(s)] = s
                    continue
                for whole_a, x in held.get(a, {}).items():
                    for whole_b, y in held.get(b, {}).items():
                        if whole_a == whole_b or min(len(x), len(y)) < threshold * max(len(x), len(y)):
                            continue
                        both = np.concatenate([x, y])
                        both.sort(kind="stable")
                        common = np.count_nonzero(both[1:] == both[:-1])
                        if (found := common / (len(x) + len(y) - common)) >= threshold:
                            out.append((a, b, whole_a, whole_b, found))
            yield pd.DataFrame(out, columns=["a", "b", "whole_a", "whole_b", "jaccard"])

    rows = members.select("bucket", F.lit(0).alias("kind"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), "members").unionByName(
        pairs.select("bucket", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("binary").alias("members"))
    )
    return rows.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInPandas(compare, "a long, b long, whole_a binary, whole_b binary, jaccard double")


def compared(docs: DataFrame, threshold: float, n: int, recall: float) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """``signatures`` of all rows, the similar pairs of unlike sets not of one ball as ``verified`` gives them, the ``balls``."""
    ensure_checkpoint_dir(docs.sparkSession)
    made = checkpointed(signatures(docs, n, threshold, recall))
    # the representative's own signature travels; the sets are equal, so any would do
    sets = checkpointed(made.groupBy("whole").agg(*[F.min(c).alias(c) for c in ("id", "grams", "values", "buckets")]))
    counts = _buckets(sets.select(F.explode("buckets").alias("bucket")), min(LEAF, HOT))
    placed = balls(made, sets, counts, threshold)
    if placed is not None:
        own = placed.select("id", "ball")
        sets = sets.join(_sent(own, own.count(), 24), "id", "left").withColumn("ball", F.coalesce("ball", F.lit(0).cast("long")))
    pairs = checkpointed(candidates(sets, threshold, counts))
    return made, verified(pairs, docs, n, threshold), placed


def jaccard_join(docs: DataFrame, threshold: float = 0.5, n: int = 3, recall: float = 0.95) -> DataFrame:
    """Pairs (doc_id_a, doc_id_b, jaccard), copies of a set with its smallest id only; see above."""
    made, near, placed = compared(docs, threshold, n, recall)
    edges = _edges(made, near)
    if placed is not None:
        edges = edges.unionByName(inside_balls(placed, docs, n, threshold, pairs=True).select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"), "jaccard"))
    return edges.groupBy("doc_id_a", "doc_id_b").agg(F.max("jaccard").alias("jaccard"))


def _edges(made: DataFrame, near: DataFrame) -> DataFrame:
    first = made.groupBy("whole").agg(F.min("id").alias("doc_id_a"), F.count("*").alias("many")).filter("many > 1")
    copies = made.select("whole", F.col("id").alias("doc_id_b")).join(first, "whole").filter("doc_id_b <> doc_id_a").select("doc_id_a", "doc_id_b", F.lit(1.0).alias("jaccard"))
    return near.filter("a <> b").select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"), "jaccard").unionByName(copies)


def _chains(inside: DataFrame) -> DataFrame:
    """Edges that connect what ``inside_balls`` found connected."""
    return inside.filter("id <> root").select(F.col("root").alias("doc_id_a"), F.col("id").alias("doc_id_b"), F.lit(1.0).alias("jaccard"))


def classes(docs: DataFrame, threshold: float = 0.5, n: int = 3, recall: float = 0.95) -> DataFrame:
    """One row (doc_id, class_id, n_links) per id; see above."""
    made, near, placed = compared(docs, threshold, n, recall)
    near = checkpointed(near.filter("a <> b"))
    members = made.select("whole", "id").distinct()
    sizes = members.groupBy("whole").agg(F.count("*").alias("size"))
    ways = near.select(F.col("whole_a").alias("from"), F.col("whole_b").alias("whole")).unionByName(near.select(F.col("whole_b").alias("from"), F.col("whole_a").alias("whole")))
    parts = [sizes.select("whole", (F.col("size") - 1).alias("size")), ways.distinct().join(sizes, "whole").select(F.col("from").alias("whole"), "size")]
    edges = _edges(made, near)
    if placed is not None:
        inside = checkpointed(inside_balls(sizes.join(_sent(placed, placed.count(), 64), "whole"), docs, n, threshold))
        parts.append(inside.select("whole", F.col("links").alias("size")))
        edges = edges.unionByName(_chains(inside))
    links = _all(parts).groupBy("whole").agg(F.sum("size").alias("links")).filter("links > 0")
    linked = members.join(links, "whole").groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(edges)
    ids = docs.select(F.col("doc_id").cast("long").alias("id")).filter("id IS NOT NULL").distinct()
    found = ids.join(linked, "id", "left").join(roots, "id", "left")
    return found.select(F.col("id").alias("doc_id"), F.coalesce("root", "id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"))


def joined(_: tuple, edges: pd.DataFrame) -> pd.DataFrame:
    """(id, root) of every id that isn't the smallest of its component."""
    ids, places = np.unique(edges[["v", "u"]].to_numpy(np.int64), return_inverse=True)
    root = np.arange(len(ids))
    one, other = places.reshape(-1, 2).T
    while True:  # roots pass along edges, then roots take the roots of their roots
        before = root.copy()
        least = np.minimum(root[one], root[other])
        for side in (one, other):
            np.minimum.at(root, root[side], least)
            np.minimum.at(root, side, least)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            break
    moved = root != np.arange(len(ids))
    return pd.DataFrame({"id": ids[moved], "root": ids[root[moved]]})


def components(edges: DataFrame, a: str = "doc_id_a", b: str = "doc_id_b") -> DataFrame:
    """(id, root) for every id in an edge, root the smallest id it connects to.

    Large-star and small-star steps until nothing changes, each written to the
    checkpoint folder; the number of rounds grows with the logarithm of a chain.
    ``FEW_EDGES``, counted, are joined by one task.
    """
    edges = checkpointed(edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).filter("u <> v").distinct())
    if edges.count() <= FEW_EDGES:
        return edges.groupBy(F.lit(0).alias("all")).applyInPandas(joined, "id long, root long")
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        large = both.filter("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        edges = large.filter("u <> v").distinct()
        least = edges.groupBy("v").agg(F.min("u").alias("m"))
        small = edges.join(least, "v").select("u", "m").unionByName(least.select(F.col("v").alias("u"), "m"))
        edges = checkpointed(small.filter("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    return edges.select(F.col("v").alias("id"), F.col("u").alias("root"))


def keep_one(docs: DataFrame, threshold: float = 0.5, n: int = 3, recall: float = 0.95) -> DataFrame:
    """The rows of ``docs`` without those that a smaller id of their group replaces.

    A group is a connected component of similar documents. Repeated rows of the
    id that stays are all kept, as are rows without an id or a set.
    """
    made, near, placed = compared(docs, threshold, n, recall)
    edges = _edges(made, near)
    if placed is not None:
        edges = edges.unionByName(_chains(inside_balls(placed, docs, n, threshold)))
    gone = checkpointed(components(edges).select("id"))
    many = gone.count()
    if 24 * many <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"))
    return packed.join(gone, "id", "left_anti").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return classes(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


#: All pairs that share an n-gram, which only small tables can afford; a document's words come in order.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> '') AS w FROM documents
), grams AS (
  SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' ')))) AS g FROM words WHERE len(w) > 0
), sized AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE both_ >= 0.5 * (x.n + y.n - both_)),
reach AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT b, root FROM reach JOIN links ON a = id),
roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT doc_id, root AS class_id, coalesce(n, 0) AS n_links FROM documents JOIN roots ON id = doc_id LEFT JOIN counts ON a = doc_id
"""
