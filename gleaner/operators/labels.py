"""Blocks aligned to gold text: labels for training.

Alignment walks two token sequences together, which no window does; it runs as a
Python map over rows, one row per page, where the page is.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions import arrow, text


def _numbered(x: Sequence, y: Sequence) -> tuple[np.ndarray, np.ndarray]:
    names: dict = {}
    return tuple(np.array([names.setdefault(t, len(names)) for t in s], np.int64) for s in (x, y))


def _rows(a: np.ndarray, b: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
    """``first`` and the rows after it; each follows from the one before by a running maximum."""
    yield first
    for item in a:
        row = first.copy()
        row[1:] = np.maximum.accumulate(np.where(b == item, first[:-1] + 1, first[1:]))
        yield row
        first = row


def common_lengths(x: Sequence, y: Sequence) -> np.ndarray:
    """Longest common subsequence of every two prefixes, (len x + 1) x (len y + 1)."""
    a, b = _numbered(x, y)
    return np.stack(list(_rows(a, b, np.zeros(len(b) + 1, np.uint32))))


#: Bits of the table of two sequences up to which all its rows are held; a row has some besides its cells.
HELD_BITS = 1 << 25
#: Items of a sequence whose places are all held as bits.
SHORT = 4096
BOTH, ONLY_X, ONLY_Y = range(3)


class _Flat:
    """Rows of the table as numbers; a bit is set where the common length doesn't rise.

    A row follows from the one before by a sum, all its bits at once (Hyyrö's form of
    the bit-parallel common subsequence); ``common_lengths`` has the lengths themselves.
    """

    def __init__(self, x: Sequence, y: Sequence):
        self.x, self.size, self.full = x, len(y), (1 << len(y)) - 1
        self.places: dict = {}
        if self.size <= SHORT:
            known: dict = {}
            for j, item in enumerate(y):
                known[item] = known.get(item, 0) | 1 << j
            self.bits = lambda item: known.get(item, 0)
            return
        for j, item in enumerate(y):
            self.places.setdefault(item, []).append(j)
        # of a long sequence the bits of so many items only
        self.bits = lru_cache(max(16, HELD_BITS // (self.size + 1)))(self._bits)

    def _bits(self, item) -> int:
        if item not in self.places:
            return 0
        found = bytearray(self.size // 8 + 1)
        for j in self.places[item]:
            found[j >> 3] |= 1 << (j & 7)
        return int.from_bytes(found, "little")

    def rows(self, start: int, end: int, row: int) -> list[int]:
        """``row``, that of ``start`` items, and those after it up to ``end`` items."""
        out, full, bits = [row], self.full, self.bits
        for item in self.x[start:end]:
            if both := row & bits(item):
                row = ((row + both) | (row - both)) & full
            out.append(row)
        return out


def _moves(x: Sequence, y: Sequence) -> bytearray:
    """The way from the ends of both sequences to their starts: BOTH go on, or one does.

    Ties drop from y first. Of the rows of a large table only about the square root of
    their number is held: those between two are made again when the way comes there.
    """
    i, j = len(x), len(y)
    table, out = _Flat(x, y), bytearray()
    step = max(1, i if i * (j + 256) <= HELD_BITS else int(i**0.5))
    held, rows, low = [table.full], [table.full], 0
    for low in range(0, i, step):
        rows = table.rows(low, min(low + step, i), held[-1])
        held.append(rows[-1])
    while i and j:
        if i - 1 < low:
            low -= step
            rows = table.rows(low, i, held[low // step])
        item, row = x[i - 1], rows[i - low]
        while j and item != y[j - 1] and row >> (j - 1) & 1:
            j -= 1
            out.append(ONLY_Y)
        if j:
            i -= 1
            if item == y[j - 1]:
                j -= 1
                out.append(BOTH)
            else:
                out.append(ONLY_X)
    return out + bytes((ONLY_X,)) * i + bytes((ONLY_Y,)) * j


def in_common(x: Sequence, y: Sequence) -> list[bool]:
    """Which items of ``x`` are in the common subsequence; ties drop from y first."""
    return [move == BOTH for move in reversed(_moves(x, y)) if move != ONLY_Y]


def diff(x: Sequence[str], y: Sequence[str]) -> list[str]:
    """Lines '  item', '- item' (only in x) and '+ item' (only in y)."""
    a, b, out = iter(x), iter(y), []
    for move in reversed(_moves(x, y)):
        if move == BOTH:
            next(b)
        out.append(f"+ {next(b)}" if move == ONLY_Y else f"{' -'[move]} {next(a)}")
    return out


@F.arrow_udf(T.ArrayType(T.BooleanType()))
def inclusion(x: pa.Array, y: pa.Array) -> pa.Array:
    """``in_common`` of two arrays; null if either is."""
    return arrow.by_pieces(in_common, x, y, pa.list_(pa.bool_()))


@F.arrow_udf(T.ArrayType(T.StringType()))
def differences(x: pa.Array, y: pa.Array) -> pa.Array:
    return arrow.by_pieces(diff, x, y, pa.list_(pa.string()))


def gold_blocks(blocks: DataFrame, gold: DataFrame, key: str = "page_id", tokenizer=text.word_tokens) -> DataFrame:
    """How much of each block is in the gold text.

    gold: key, content, comments. Gives key, block_idx, frac_content,
    frac_comments, block_tokens, content_tokens, comment_tokens. Pages without gold
    text are left out; a block without a token has fractions of 0.
    """
    rows = blocks.select(key, F.struct("block_idx", tokenizer(F.col("text")).alias("tokens")).alias("b"))
    rows = rows.groupBy(key).agg(F.array_sort(F.collect_list("b")).alias("bs"))
    tokens = lambda c: F.coalesce(tokenizer(F.col(c)), F.array().cast("array<string>"))
    rows = rows.join(gold.select(key, tokens("content").alias("content"), tokens("comments").alias("comments")), key)
    kind = blocks.schema[key].dataType.simpleString()
    schema = f"key string, block_idx int, frac_content double, frac_comments double, block_tokens array<string>, content_tokens array<string>, comment_tokens array<string>"  # noqa: F541

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bs = b.column("bs")
            words = arrow.bounds(arrow.lengths(bs.flatten().field("tokens")))[arrow.bounds(arrow.lengths(bs))]
            for start, n in arrow.pieces(np.diff(words) + sum(arrow.lengths(b.column(c)) for c in ("content", "comments"))):
                yield _aligned(b.slice(start, n))

    made = rows.select(F.col(key).cast("string").alias("key"), "bs", "content", "comments").mapInArrow(apply, schema)
    return made.select(F.col("key").cast(kind).alias(key), *made.columns[1:])


def _aligned(pages: pa.RecordBatch) -> pa.RecordBatch:
    """The columns of ``gold_blocks`` for pages of (key, bs, content, comments)."""
    n_blocks, blocks = arrow.lengths(pages.column("bs")), pages.column("bs").flatten()
    tokens = blocks.field("tokens")
    words, at = tokens.flatten(), arrow.bounds(arrow.lengths(tokens))
    flat, pages_at = words.to_numpy(zero_copy_only=False).tolist(), at[arrow.bounds(n_blocks)]
    shares, found = [], []
    for c in ("content", "comments"):
        mark = np.fromiter((m for a, b, g in zip(pages_at, pages_at[1:], arrow.lists(pages.column(c))) for m in in_common(flat[a:b], g)), bool, len(flat))
        own = arrow.bounds(mark)[at]
        shares.append(np.diff(own) / np.maximum(np.diff(at), 1))
        found.append(pa.ListArray.from_arrays(pa.array(own, pa.int32()), words.filter(pa.array(mark))))
    keys = pages.column("key").take(pa.array(np.repeat(np.arange(pages.num_rows), n_blocks)))
    whole = pa.ListArray.from_arrays(pa.array(at, pa.int32()), words)
    names = ["key", "block_idx", "frac_content", "frac_comments", "block_tokens", "content_tokens", "comment_tokens"]
    return pa.RecordBatch.from_arrays([keys, blocks.field("block_idx"), *map(pa.array, shares), whole, *found], names)


def block_labels(gold: DataFrame, threshold: float = 0.1, key: str = "page_id") -> DataFrame:
    """(key, block_idx, content, comments, weight) by the share of gold tokens.

    The label is 1 above the threshold; the weight is the number of tokens.
    """
    if not 0.0 <= threshold <= 1.0:
        raise ValueError(f"the threshold is a share, not {threshold}")
    label = lambda c: (F.col(c) > threshold).cast("int")
    return gold.select(key, "block_idx", label("frac_content").alias("content"), label("frac_comments").alias("comments"), F.size("block_tokens").alias("weight"))


def content_tokens(gold: DataFrame, column: str = "content_tokens", key: str = "page_id") -> DataFrame:
    """(key, tokens): the tokens of a page's blocks in order, blocks without any left out."""
    parts = gold.filter(F.size(column) > 0).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("block_idx", F.col(column).alias("t")))).alias("p"))
    return parts.select(key, F.flatten(F.transform("p", lambda x: x["t"])).alias("tokens"))


def unprocessed(pages: DataFrame, done: DataFrame, key: str = "page_id") -> DataFrame:
    """Pages that aren't in ``done``."""
    return pages.join(done.select(key), key, "left_anti")


def read_again(gold: DataFrame, key: str = "page_id") -> DataFrame:
    """Gold blocks with their tokens as lines hold them, split again: no empty ones."""
    tokens = ("block_tokens", "content_tokens", "comment_tokens")
    return gold.withColumns({c: F.filter(F.split(F.array_join(c, " "), " "), lambda t: t != "") for c in tokens})


def merged(a: Column, b: Column) -> Column:
    """1 where either label is."""
    return F.greatest(a, b)
