"""Packing against a linear search over all bins."""

import random

import pytest
from common import AWKWARD, docs, records

from gleaner.llm import packing


def brute(ids, lengths, sources, clusters, capacity):
    order = sorted((-(n % capacity), ids[i], str(clusters[i]), i) for i, n in enumerate(lengths) if n % capacity)
    bins, where = [], {}
    for rest, _, _, i in order:
        fits = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= -rest and sources[i] not in b["sources"] and (clusters[i] is None or clusters[i] not in b["clusters"])]
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append({"left": capacity, "sources": set(), "clusters": set()})
        bins[k]["left"] += rest
        bins[k]["sources"].add(sources[i])
        bins[k]["clusters"].add(clusters[i])
        where[i, lengths[i] // capacity] = k
    return where, len(bins)


@pytest.mark.parametrize("seed", range(6))
def test_tightest_compatible_bin(seed):
    rng = random.Random(seed)
    n, capacity = 300, rng.choice([20, 64, 500])
    ids, lengths = list(range(n)), [rng.randint(1, 2 * capacity) for _ in range(n)]
    sources = [rng.choice(["a", "b", "c", "d", None, "f"]) for _ in range(n)]
    clusters = [rng.choice([None, *range(40)]) for _ in range(n)]
    made = packing.pack_shard(ids, lengths, sources, clusters, capacity)
    where, bins = brute(ids, lengths, sources, clusters, capacity)
    assert {(i, p): b for i, p, b, _, _ in made if (i, p) in where} == where
    assert len(made) == len({(i, p) for i, p, *_ in made}) == sum(-(-x // capacity) for x in lengths)
    held = {}
    for i, _, b, at, size in made:
        held.setdefault(b, []).append((at, size, i))
    assert sum(size for xs in held.values() for _, size, _ in xs) == sum(lengths)
    for b, xs in held.items():
        assert sorted(a for a, _, _ in xs) == list(range(len(xs))) and sum(s for _, s, _ in xs) <= capacity
        assert len({sources[i] for *_, i in xs}) == len(xs)


def test_awkward(spark):
    got = records(packing.pack(docs(spark, AWKWARD), capacity=1000), "doc_id", "piece", "n_tokens")
    assert sum(n for i, _, n in got if i == 5) == 60_000 and len([1 for i, *_ in got if i == 5]) == 60
    assert [x for x in got if x[0] != 5] == [(6, 0, 3), (6, 0, 3), (7, 0, 3), (8, 0, 5), (None, 0, 6)]
    bins = records(packing.pack(docs(spark, AWKWARD), capacity=1000).filter("doc_id IN (6, 7)"), "bin_id")
    assert len(set(bins)) == 3  # a source or a cluster never twice in a bin
    assert packing.pack(docs(spark, AWKWARD).limit(0)).count() == 0


def test_many_shards(spark):
    df = docs(spark, [(i, "w " * (1 + i % 50), f"s{i % 9}") for i in range(500)])
    got = packing.pack(df, capacity=100, shard_tokens=1000).collect()
    assert sum(r.n_tokens for r in got) == sum(1 + i % 50 for i in range(500)) and len({r.bin_id >> 32 for r in got}) > 3


def test_rows_of_one_id_fill_several_shards(spark):
    rows = [(None, "w " * 10, "a")] * 200 + [(7, "w " * 10, "b")] * 200 + [(i, "w " * 10, "c") for i in range(100, 150)]
    got = packing.pack(docs(spark, rows).repartition(3), capacity=100, shard_tokens=500).collect()
    assert records_of(got) == sorted([(None, 10)] * 200 + [(7, 10)] * 200 + [(i, 10) for i in range(100, 150)], key=repr)
    held = {}
    for r in got:
        held.setdefault(r.bin_id >> 32, []).append(r.n_tokens)
    assert max(map(sum, held.values())) <= 1500
    assert len({(r.bin_id, r.position) for r in got}) == len(got)


def records_of(rows):
    return sorted(((r.doc_id, r.n_tokens) for r in rows), key=repr)


def test_query_against_brute_force(spark, tmp_path):
    """The registered query on a table of one shard, with its production capacity."""
    rng = random.Random(12)
    base = [" ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.choice([3, 40, 700, 1500, 2048, 5000]))) for _ in range(120)]
    rows = [(i, rng.choice([t, t.upper(), t + " \n"]), rng.choice(["a", "b", "c", None, "d"])) for i, t in enumerate(base * 2)] + [(900, "", "a"), (901, None, "a")]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = packing.query(spark, str(tmp_path)).collect()
    lengths = [len((t or "").split()) for _, t, _ in rows]
    live = [k for k, n in enumerate(lengths) if n]
    plain = [" ".join(rows[k][1].lower().split()) for k in live]
    where, _ = brute([rows[k][0] for k in live], [lengths[k] for k in live], [rows[k][2] for k in live], plain, 2048)
    found = {(r.doc_id, r.piece): r.bin_id for r in got}
    # ids are unlike, so clusters decide no tie
    assert {k: found[k] for k in ((rows[live[i]][0], p) for i, p in where)} == {(rows[live[i]][0], p): b for (i, p), b in where.items()}
    assert len(got) == sum(-(-n // 2048) for n in lengths)
