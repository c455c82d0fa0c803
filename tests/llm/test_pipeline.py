"""The pipeline: each stage against its contract, the whole against its stages, SQL where there is one."""

import collections
import hashlib
import os
import random

import duckdb
import numpy as np
import pytest
import test_jaccard
import test_line_dedup
import test_packing
import test_quality
from common import AWKWARD, docs
from pyspark.sql import functions as F

import corpus_pipeline
from gleaner.llm import queries

SF = "/root/testdata/sf0.01"


def test_stages_and_run(spark):
    df, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = df.columns
    for name, stage in corpus_pipeline.STAGES:
        before = df
        df = stage(spark, df, SF).cache()
        ids, old = {r.doc_id for r in df.select("doc_id").collect()}, {r.doc_id for r in before.select("doc_id").collect()}
        assert ids <= old
        kept.append(len(ids))
        if name != "packing":
            assert df.columns == columns
    assert kept == sorted(kept, reverse=True) and kept[0] > 600 and kept[2] < kept[1] and kept[4] == kept[3]
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(corpus_pipeline.run(spark, SF)) == rows(df)


def brute_mixing(rows):
    """The rows that are drawn: raking on dictionaries."""
    size = lambda t: -(-len(t.encode()) // 4)

    def topic(t):
        low = t.lower()
        if "licen" in low or "all rights reserved" in low:
            return "legal"
        return "tabular" if " | " in t else "noisy" if "***" in t or "!!" in t else "brief" if len(t.encode()) < 400 else "prose"

    keys = {i: (s, lang, topic(t)) for i, t, s, lang in rows}
    present = collections.Counter()
    for i, t, *_ in rows:
        present[keys[i]] += size(t)
    total = 0.5 * sum(present.values())
    goals = []
    for part in range(3):
        have = collections.Counter()
        for k, n in present.items():
            have[k[part]] += n
        low, high = 0.0, max(n**0.3 for n in have.values())
        for _ in range(200):  # the scale at which the cut goals sum to the total
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(n, mid * n**0.7) for n in have.values()) < total else (low, mid)
        goals.append({v: min(n, high * n**0.7) for v, n in have.items()})
    w = {k: n / 2 for k, n in present.items()}
    for _ in range(3000):
        for part, goal in enumerate(goals):
            now = collections.Counter()
            for k, x in w.items():
                now[k[part]] += x
            w = {k: min(present[k], x * goal[k[part]] / now[k[part]]) for k, x in w.items()}
    u = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) / 2**32
    return [r for r in rows if u(r[0]) < w[keys[r[0]]] / present[keys[r[0]]]]


def test_run_against_brute_force(spark, tmp_path):
    """All five stages in plain Python, from test_quality, test_line_dedup, test_jaccard and test_packing."""
    rng = random.Random(21)
    any_, bad = [f"word{i}" for i in range(400)], [f"bad{i}" for i in range(15)]
    line = lambda own, n: " ".join(rng.choice(own if rng.random() < 0.4 else any_) for _ in range(n))
    rows, shared = [], [line(any_, 60) for _ in range(4)]
    for i in range(220):
        kind = rng.random()
        if kind < 0.2:
            text = "\n".join(line(bad, rng.randint(20, 60)) for _ in range(2))
        elif kind < 0.45 and rows:  # a near copy, or a copy
            words = rng.choice(rows)[1].split(" ")
            text = " ".join(w if rng.random() > 0.01 * (i % 2) else "other" for w in words)
        else:
            text = "\n".join(line(any_, rng.choice([15, 80, 300, 2500])) for _ in range(rng.randint(1, 4)))
            text += rng.choice(["", "\n" + rng.choice(shared), "\nAll rights reserved", " | a | b"])
        rows.append((i, text, rng.choice("abcde"), rng.choice(["en", "de"])))
    labels = [(i, int("bad" not in t), int(t.count("bad") > 30)) for i, t, *_ in rows if i % 2]
    spark.createDataFrame([(i, t, lang, s, len(t)) for i, t, s, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    sizes, texts, kept = [len(rows)], {i: t for i, t, *_ in rows}, rows
    for column, sign in ((1, 1), (2, -1)):
        y = np.array([1.0 if (x[column] > 0) == (sign > 0) else -1.0 for x in labels])
        scores = dict(zip(texts, test_quality.brute([texts[i] for i, *_ in labels], y)(list(texts.values()))))
        assert min(map(abs, scores.values())) > 0.05  # nothing is in doubt
        kept = [r for r in kept if scores[r[0]] >= 0]
    sizes.append(len(kept))
    left = {i: t for i, t, _ in test_line_dedup.brute([(i, t, s) for i, t, s, _ in kept])}
    kept = [(i, left[i], s, lang) for i, _, s, lang in kept if i in left]
    sizes.append(len(kept))
    pairs = test_jaccard.brute([(i, t) for i, t, *_ in kept])
    kept = [r for r, (i, root, _) in zip(sorted(kept), test_jaccard.brute_classes([(i, t) for i, t, *_ in kept], pairs)) if i == root]
    sizes.append(len(kept))
    kept = brute_mixing(kept)
    sizes.append(len(kept))
    assert sizes == sorted(set(sizes), reverse=True), sizes  # every stage drops something
    lengths = [len(t.split()) for _, t, *_ in kept]
    where, bins = test_packing.brute([i for i, *_ in kept], lengths, [s for _, _, s, _ in kept], [" ".join(t.lower().split()) for _, t, *_ in kept], 2048)
    want, filled = [], collections.Counter()
    for k in sorted(range(len(kept)), key=lambda k: (-(lengths[k] % 2048), kept[k][0])):
        if lengths[k] % 2048:
            b = where[k, lengths[k] // 2048]
            want.append((kept[k][0], lengths[k] // 2048, b, filled[b], lengths[k] % 2048))
            filled[b] += 1
    alone = [(kept[k][0], piece) for k in sorted(range(len(kept)), key=lambda k: kept[k][0]) for piece in range(lengths[k] // 2048)]
    want += [(i, piece, bins + n, 0, 2048) for n, (i, piece) in enumerate(alone)]
    assert got == sorted(want)


def test_columns_that_clash(spark):
    df = docs(spark, [(i, f"line {i}\nsame line of all", "s") for i in range(5)]).withColumns({"lines_removed": F.lit("mine"), "probability": F.lit(2), "keep": F.lit("no"), "now": F.lit("x"), "version": F.lit(1), "lines": F.lit("y")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, df, SF)
        assert made.columns == df.columns
        assert {(r.lines_removed, r.probability, r.keep, r.now, r.version, r.lines) for r in made.collect()} <= {("mine", 2, "no", "x", 1, "y")}


def test_stages_survive_awkward_rows(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs(spark, AWKWARD), SF).count() <= 100
        assert stage(spark, docs(spark, AWKWARD).limit(0), SF).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got, want = queries.queries()[name](spark, SF).toPandas(), c.execute(queries.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    rows = lambda d: sorted(map(tuple, d[columns].astype(str).values.tolist()))
    assert rows(got) == rows(want)


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
