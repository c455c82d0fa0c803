"""Line dedup against a loop, the filter, and insertions taken back."""

import os
import random
import time

import numpy as np
from common import AWKWARD, docs, records
from pyspark.sql import functions as F

from gleaner.llm import line_dedup
from gleaner.llm.shared import ensure_checkpoint_dir


def brute(rows):
    seen, out = set(), []
    for i, text, _ in sorted(rows):
        lines = text.split("\n")
        kept = [x for x in lines if not x.strip(" ") or (x.strip(" ") not in seen and not seen.add(x.strip(" ")))]
        if len(kept) == len(lines) or any(x.strip(" ") for x in kept):
            out.append((i, "\n".join(kept), len(lines) - len(kept)))
    return out


def test_whole_table(spark):
    rng = random.Random(8)
    rows = [(i, "\n".join(rng.choice(["", " ", *[f"line {j}" for j in range(300)], " line 5 ", "hot", "hot"]) for _ in range(rng.randint(1, 30))), "s") for i in rng.sample(range(10_000), 200)]
    got = line_dedup.drop_repeated_lines(docs(spark, rows).repartition(5))
    assert records(got, "doc_id", "text", "lines_removed") == sorted(brute(rows), key=repr)
    assert all(r.n_chars == len(r.text) for r in got.collect())


def test_awkward(spark):
    df = docs(spark, AWKWARD)
    got = line_dedup.drop_repeated_lines(df)
    assert got.columns == [*df.columns, "lines_removed"]
    # the same text of 6 and 7 stays once, with 6; its repeated row is one document
    assert [r.doc_id for r in got.orderBy("doc_id").collect()] == [None, 1, 2, 3, 5, 6, 8]
    assert {r.doc_id: r.text for r in got.collect()}[5] == dict((i, t) for i, t, _ in AWKWARD)[5]
    assert line_dedup.drop_repeated_lines(df.limit(0)).count() == 0


def test_filter_has_no_false_negatives():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 1 << 63, 5000, dtype=np.int64).view(np.uint64)
    f = line_dedup.CuckooFilter(6000)
    assert f.add(h) and f.contains(h).all() and f.contains(rng.integers(0, 1 << 63, 5000, dtype=np.int64).view(np.uint64)).mean() < 0.01
    f.remove(h[:2500])
    assert f.contains(h[2500:]).all() and f.contains(h[:2500]).mean() < 0.01


def entries(index):
    return records(index.refs(), "h1", "h2", "refs")


def test_insertions_are_reversible(spark, tmp_path):
    index = line_dedup.LineIndex(spark, str(tmp_path), shards=3)
    a = docs(spark, [(1, "x\ny\nx", "s"), (2, "y\nz", "s"), (9, None, "s")])
    b = docs(spark, [(3, "z\nq", "s"), (4, "q\nx", "s")])
    assert records(index.insert(a), "id", "line_no") == [(1, 0), (1, 1), (2, 1)]
    before = entries(index)
    assert sorted(r[2] for r in before) == [1, 2, 2]
    assert records(index.insert(b), "id", "line_no") == [(3, 1)]
    index.delete(b)
    assert entries(index) == before
    index.delete(a)
    assert index.refs().count() == 0
    index.delete(a)  # what isn't there is ignored
    assert index.refs().count() == 0
    assert records(index.insert(b), "id", "line_no") == [(3, 0), (3, 1), (4, 1)]


def test_an_index_is_opened_again(spark, tmp_path):
    rng = random.Random(1)
    batches = [docs(spark, [(100 * k + i, "\n".join(f"line {rng.randint(0, 150)}" for _ in range(8)), "s") for i in range(20)]) for k in range(4)]
    index = line_dedup.LineIndex(spark, str(tmp_path), shards=4)
    index.insert(batches[0])
    index.insert(batches[1])
    again = line_dedup.LineIndex(spark, str(tmp_path))
    assert (again.version, again.shards) == (2, 4) and entries(again) == entries(index)
    assert again.insert(batches[0]).count() == 0
    again.delete(batches[0])
    # a change that broke off before its commit left tables of version 5
    again.refs().select("h1", "h2", "refs", "shard").write.partitionBy("shard").parquet(f"{tmp_path}/refs/v=5")
    third = line_dedup.LineIndex(spark, str(tmp_path))
    assert third.version == 4 and entries(third) == entries(index)
    third.insert(batches[2])
    third.delete(batches[0])
    third.compact(shards=7)
    fresh = line_dedup.LineIndex(spark, str(tmp_path / "other"), shards=2)
    fresh.insert(batches[1].unionByName(batches[2]))
    assert entries(line_dedup.LineIndex(spark, str(tmp_path))) == entries(fresh)
    # the filters know every line of the table
    held = {r["shard"]: line_dedup.CuckooFilter.read(r["filter"]) for r in third.filters().collect()}
    assert len(held) > 1 and all(held[r["shard"]].contains(np.array([r["h1"]]).view(np.uint64))[0] for r in third.refs().collect())


def test_only_shards_with_changes_are_written(spark, tmp_path):
    index = line_dedup.LineIndex(spark, str(tmp_path), shards=16)
    index.insert(docs(spark, [(i, f"line {i}", "s") for i in range(200)]))
    index.insert(docs(spark, [(1000, "one more line", "s")]))
    assert len([p for p in os.listdir(tmp_path / "refs/v=2") if p.startswith("shard=")]) == 1
    assert spark.read.parquet(str(tmp_path / "filters/v=2")).count() == 1


def test_a_full_filter_is_built_anew(spark, tmp_path):
    index = line_dedup.LineIndex(spark, str(tmp_path), shards=1)
    index.insert(docs(spark, [(1, "first", "s")]))
    many = docs(spark, [(2 + i, "\n".join(f"line {i} {j}" for j in range(100)), "s") for i in range(50)])
    assert index.insert(many).count() == 5000
    assert index.insert(many).count() == 0 and index.refs().count() == 5001


def test_batches_give_what_one_table_gives(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choice(["hot", *[f"line {j}" for j in range(100)]]) for _ in range(rng.randint(1, 9))), "s") for i in range(90)]
    index, got = line_dedup.LineIndex(spark, str(tmp_path)), []
    for k in range(0, 90, 30):
        got += records(line_dedup.drop_repeated_lines(docs(spark, rows[k : k + 30]), index), "doc_id", "text", "lines_removed")
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_rows_that_share_an_id(spark):
    rows = [(1, "q", "a"), (1, "q", "b"), (1, "q\nr", "a"), (None, None, "a"), (None, None, "b"), (None, " \n", "a"), (None, " \n", "a"), (None, "t", "a"), (None, "t", "a"), (None, "t\nu", "b")]
    got = sorted(((r.doc_id, r.text) for r in line_dedup.drop_repeated_lines(docs(spark, rows)).collect()), key=repr)
    assert got.count((None, None)) == 2 and got.count((None, " \n")) == 2
    rest = [x for x in got if x[1] and x[1].strip()]
    assert sorted(line for _, t in rest for line in t.split("\n")) == ["q", "r", "t", "u"]


def test_a_document_of_many_repeated_lines(spark):
    long = "\n".join(["again", "and"] * 40_000 + ["end"])
    began = time.time()
    got = line_dedup.drop_repeated_lines(docs(spark, [(1, long, "s"), (2, "end", "s")])).collect()
    assert [(r.doc_id, r.text, r.lines_removed) for r in got] == [(1, "again\nand\nend", 79_998)] and time.time() - began < 40


def test_no_index_is_left_behind(spark):
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    line_dedup.drop_repeated_lines(docs(spark, [(1, "a\nb", "s")])).count()
    assert os.path.isdir(folder) and not [p for p in os.listdir(folder) if p.startswith("lines-")]


def test_names_of_the_count(spark):
    df = docs(spark, [(1, "a\na", "s")]).withColumn("lines_removed", F.lit("mine"))
    assert [tuple(r) for r in line_dedup.drop_repeated_lines(df).select("text", "lines_removed").collect()] == [("a", 1)]
    kept = line_dedup.drop_repeated_lines(df, removed=None)
    assert kept.columns == df.columns and kept.first().lines_removed == "mine"


def test_index_awkward(spark, tmp_path):
    index = line_dedup.LineIndex(spark, str(tmp_path))
    assert index.insert(docs(spark, AWKWARD).limit(0)).count() == 0 and index.refs().count() == 0
    index.delete(docs(spark, AWKWARD))
    assert index.refs().count() == 0
    assert index.insert(docs(spark, AWKWARD)).count() == 5  # a tab is a line
    # the text of 6, 6 and 7 is one line of three references
    assert sorted(r[2] for r in entries(index)) == [1, 1, 1, 1, 3]
    index.compact()
    index.delete(docs(spark, AWKWARD))
    assert index.refs().count() == 0 and line_dedup.LineIndex(spark, str(tmp_path)).version == 5
