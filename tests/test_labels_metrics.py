"""Alignment, labels, metrics and distances."""

import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.functions import arrow
from gleaner.operators import blocks, labels, metrics
from gleaner.plans import queries


def test_inclusion_and_ties():
    assert labels.in_common(list("xaybc"), list("abc")) == [False, True, False, True, True]
    assert labels.in_common(list("ab"), list("ba")) == [False, True]
    assert labels.in_common(["a"], []) == [False] and labels.in_common([], ["a"]) == []


def test_common_lengths_against_recursion():
    r = random.Random(3)
    for _ in range(60):
        x, y = ([r.choice("abc") for _ in range(r.randrange(9))] for _ in range(2))
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                table[i + 1][j + 1] = table[i][j] + 1 if a == b else max(table[i][j + 1], table[i + 1][j])
        assert labels.common_lengths(x, y).tolist() == table
        marked = [t for t, m in zip(x, labels.in_common(x, y)) if m]
        assert len(marked) == table[-1][-1]
        rest = iter(y)
        assert all(t in rest for t in marked)
        d = labels.diff(x, y)
        assert [l[2:] for l in d if l[0] in " -"] == x and [l[2:] for l in d if l[0] in " +"] == y


@pytest.mark.parametrize("a, b, want", [("ab", "bca", 3), ("ba", "abc", 2), ("free", "deer", 3), ("ca", "abc", 3), ("abcd", "abdc", 1), ("", "xy", 2), ("same", "same", 0)])
def test_distance(spark, a, b, want):
    assert metrics.osa(a, b) == want == metrics.osa(b, a)
    df = spark.createDataFrame([(list(a), list(b), a, None)], "x array<string>, y array<string>, s string, n string")
    assert tuple(df.select(metrics.osa_distance("x", "y"), metrics.osa_distance("s", "n")).first()) == (want, None)


def test_token_overlap(spark):
    a, b = "to be or not to be that is".split(), "to be or maybe not".split()
    df = spark.createDataFrame([(1, a, b), (2, [], [])], "k int, p array<string>, a array<string>")
    one, two = df.orderBy("k").select(*[c.alias(n) for n, c in metrics.token_overlap(F.col("p"), F.col("a")).items()]).collect()
    assert tuple(one) == pytest.approx((4 / 6, 4 / 5, 2 * (4 / 6) * (4 / 5) / (4 / 6 + 4 / 5)))
    assert tuple(two) == (0, 0, 0)
    one, two = metrics.token_overlap_counted(df, "k", "p", "a").orderBy("k").collect()
    assert (one.precision, one.recall) == pytest.approx((4 / 8, 4 / 5))
    assert (two.precision, two.recall, two.f1) == (0, 0, 0)
    j = df.orderBy("k").select(metrics.token_jaccard(F.col("p"), F.col("a"))).collect()
    assert (j[0][0], j[1][0]) == (pytest.approx(4 / 7), None)


def test_classification(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 0, 1.0), (0, 1, 3.0), (0, 0, 4.0)], "a int, p int, w double")
    r = metrics.classification(df, "a", "p", "w").first()
    assert tuple(r) == pytest.approx((6 / 10, 2 / 5, 2 / 3, 2 * (2 / 5) * (2 / 3) / (2 / 5 + 2 / 3)))
    assert tuple(metrics.classification(df.limit(0), "a", "p").first()) == (0, 0, 0, 0)


def test_gold_blocks_and_labels(spark):
    pages = spark.createDataFrame([("a", "<div>menu here</div><p>the real story, told</p><div>nice story</div>"), ("b", "<script>1</script>")], "page_id string, html string")
    gold = spark.createDataFrame([("a", "the real story told", "nice story"), ("b", "", None)], "page_id string, content string, comments string")
    made = labels.gold_blocks(blocks.blocks(pages, tolerant=True), gold).orderBy("block_idx").collect()
    assert [(r.frac_content, r.frac_comments) for r in made] == [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)]
    assert made[1].block_tokens == made[1].content_tokens == ["the", "real", "story", "told"]
    rows = labels.block_labels(spark.createDataFrame(made)).orderBy("block_idx").collect()
    assert [(r.content, r.comments, r.weight) for r in rows] == [(0, 0, 2), (1, 0, 4), (0, 1, 2)]
    with pytest.raises(ValueError):
        labels.block_labels(spark.createDataFrame(made), 1.5)
    assert labels.content_tokens(spark.createDataFrame(made)).first().tokens == ["the", "real", "story", "told"]
    assert labels.unprocessed(pages, spark.createDataFrame([("a",)], "page_id string")).count() == 1


def test_long_sequences_hold_few_rows():
    rng = random.Random(5)
    x = [rng.choice("abcdefgh") for _ in range(3000)]
    y = [t for t in x if rng.random() < 0.8] + ["z"] * 70_000
    tracemalloc.start()
    marks = labels.in_common(x, y)
    assert tracemalloc.get_traced_memory()[1] < 100e6  # the whole table has 870 MB
    tracemalloc.stop()
    assert sum(marks) == len(y) - 70_000
    rest = iter(y)
    assert all(t in rest for t, m in zip(x, marks) if m)


def test_alignment_takes_less_than_the_table():
    rng = random.Random(6)
    x = [rng.choice(range(300)) for _ in range(4000)]
    y = [t for t in x if rng.random() < 0.8]
    took = []
    for made in (labels.in_common, labels.common_lengths):
        start = time.perf_counter()
        made(x, y)
        took.append(time.perf_counter() - start)
    assert took[0] < took[1] / 2


@pytest.mark.parametrize("held, short", [(1 << 25, 4096), (1 << 25, 0), (600, 0), (0, 3)])
def test_alignment_whatever_is_held(monkeypatch, held, short):
    rng = random.Random(7)
    monkeypatch.setattr(labels, "HELD_BITS", held)
    monkeypatch.setattr(labels, "SHORT", short)
    for _ in range(300):
        x, y = ([rng.choice("abcd") for _ in range(rng.randrange(25))] for _ in range(2))
        i, j, want, table = len(x), len(y), [], labels.common_lengths(x, y)
        while i or j:
            if i and j and x[i - 1] == y[j - 1]:
                i, j = i - 1, j - 1
                want.append(f"  {x[i]}")
            elif j and (not i or table[i][j - 1] >= table[i - 1][j]):
                j -= 1
                want.append(f"+ {y[j]}")
            else:
                i -= 1
                want.append(f"- {x[i]}")
        assert labels.diff(x, y) == want[::-1]
        assert labels.in_common(x, y) == [t[0] == " " for t in want[::-1] if t[0] != "+"]


def test_lists_become_objects_in_pieces(monkeypatch):
    monkeypatch.setattr(arrow, "PIECE", 10)
    x = pa.array([["a"] * n for n in (3, 30, 0, 4, 4)] + [None, ["b"]])
    assert list(arrow.pieces(arrow.lengths(x), 10)) == [(0, 1), (1, 1), (2, 5)]
    held = []
    made = arrow.by_pieces(lambda a, b: held.append(len(a)) or a, x.slice(1), x.slice(1), pa.list_(pa.string()))
    assert made.to_pylist() == x.to_pylist()[1:] and held == [30, 0, 4, 4, 1]


def test_gold_queries_against_loops(spark):
    """Labels of the whole query, by the table of the definition."""
    sf = "/root/testdata/sf0.001"
    gold = {r.page_id: r for r in queries.gold_texts(spark, sf).collect()}
    rows = {}
    for r in queries.tolerant_blocks(spark, sf).orderBy("page_id", "block_idx").select("page_id", "block_idx", "text").collect():
        rows.setdefault(r.page_id, []).append((r.block_idx, re.findall(r"[^\W_]+", r.text)))
    want = set()
    for page, blocks_ in rows.items():
        flat = [t for _, ts in blocks_ for t in ts]
        marks = []
        for text_ in (gold[page].content, gold[page].comments):
            other = re.findall(r"[^\W_]+", text_)
            c = np.zeros((len(flat) + 1, len(other) + 1), int)
            for i, t in enumerate(flat):
                same = np.array([t == o for o in other], bool)
                c[i + 1, 1:] = np.maximum.accumulate(np.maximum(np.where(same, c[i, :-1] + 1, 0), c[i, 1:])) if other else 0
            i, j, mark = len(flat), len(other), [False] * len(flat)
            while i and j:
                if flat[i - 1] == other[j - 1]:
                    mark[i - 1], i, j = True, i - 1, j - 1
                elif c[i, j - 1] >= c[i - 1, j]:
                    j -= 1
                else:
                    i -= 1
            marks.append(mark)
        at = 0
        for number, ts in blocks_:
            shares = [sum(m[at : at + len(ts)]) / len(ts) for m in marks]
            want.add((page, number, *[int(s > 0.1) for s in shares], len(ts)))
            at += len(ts)
    got = {tuple(r) for r in queries.block_labels(spark, sf).select("page_id", "block_idx", "content", "comments", "weight").collect()}
    assert got == want and {r[2] for r in got} == {r[3] for r in got} == {0, 1}
    sums = {r.page_id: tuple(r)[1:] for r in queries.label_summary(spark, sf).collect()}
    for page in rows:
        own = [r for r in want if r[0] == page]
        assert sums[page] == tuple(sum(r[4] for r in own if test(r)) for test in (lambda r: True, lambda r: r[2], lambda r: r[3], lambda r: r[2] or r[3]))
    words = {r.page_id: r.tokens for r in queries.page_gold_tokens(spark, sf).collect()}
    assert all(words[p] in " ".join(t for _, ts in b for t in ts) or words[p] for p, b in rows.items()) and len(words) == len(rows)
