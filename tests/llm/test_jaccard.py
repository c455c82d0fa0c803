"""The Jaccard join against all pairs."""

import collections
import itertools
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from common import AWKWARD, docs, records

from gleaner.llm import jaccard


def grams(text, n=3):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, threshold=0.5):
    sets = [(i, g) for i, t in rows if (g := grams(t))]
    out = {}
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if min(len(a), len(b)) >= threshold * max(len(a), len(b)) and (s := len(a & b) / len(a | b)) >= threshold:
            out[min(i, j), max(i, j)] = s
    return out


def unfolded(made):
    """All pairs of the short form, copies unfolded."""
    star = {}
    for p, s in made.items():
        if s == 1.0:
            star.setdefault(p[0], [p[0]]).append(p[1])
    out = {}
    for (a, b), s in made.items():
        for x, y in itertools.product(star.get(a, [a]), star.get(b, [b])) if s < 1.0 else ():
            out[min(x, y), max(x, y)] = s
    for members in star.values():
        out |= {(min(x, y), max(x, y)): 1.0 for x, y in itertools.combinations(members, 2)}
    return out


def brute_classes(rows, pairs):
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    links = collections.Counter(x for p in pairs for x in p)
    return sorted((i, find(i), links[i]) for i in root)


def check(spark, rows):
    want = brute(rows)
    made = jaccard.jaccard_join(docs(spark, [(i, t, "s") for i, t in rows]).repartition(4))
    got = unfolded({(r.doc_id_a, r.doc_id_b): r.jaccard for r in made.collect()})
    assert all(abs(want[p] - s) < 1e-9 for p, s in got.items())  # nothing false
    assert len(got) >= 0.9 * len(want), (len(got), len(want))
    return want, got


def test_generated_copies(spark):
    rng = random.Random(6)
    word = lambda: f"v{rng.randint(0, 3000)}"
    rows, n = [], 0
    for size in [1] * 60 + [2] * 30 + [5] * 10 + [400]:
        base = [word() for _ in range(rng.randint(20, 90))]
        for _ in range(size):
            copy = [word() if rng.random() < rng.choice([0, 0.02, 0.08]) else w for w in base]
            rows.append((n := n + 1, " ".join(copy)))
    check(spark, rows)


def test_documents(spark):
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    t += [x for x in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist() if x["doc_id"] >= len(t)]
    want, _ = check(spark, [(x["doc_id"], x["text"]) for x in {x["doc_id"]: x for x in t}.values()])
    assert want


def test_awkward(spark):
    got = records(jaccard.jaccard_join(docs(spark, AWKWARD)), "doc_id_a", "doc_id_b", "jaccard")
    assert got == [(6, 7, 1.0)]
    kept = jaccard.keep_one(docs(spark, AWKWARD))
    assert kept.columns == docs(spark, AWKWARD).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "5", "6", "6", "8", "None"]
    assert jaccard.jaccard_join(docs(spark, AWKWARD).limit(0)).count() == 0
    assert jaccard.keep_one(docs(spark, AWKWARD).limit(0)).count() == 0


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(jaccard, "FEW_EDGES", few)
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100 + i, 100 + rng.randint(0, i)) for i in range(50)] + [(500, 501), (501, 501)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = sorted((x, find(x)) for x in root if find(x) != x)
    rng.shuffle(edges)
    got = records(jaccard.components(spark.createDataFrame(edges, "doc_id_a long, doc_id_b long")), "id", "root")
    assert sorted(x for x in got if x[0] != x[1]) == want


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_components_of_nothing(spark, monkeypatch, few):
    monkeypatch.setattr(jaccard, "FEW_EDGES", few)
    none = spark.createDataFrame([], "doc_id_a long, doc_id_b long")
    assert jaccard.components(none).count() == 0
    assert jaccard.components(spark.createDataFrame([(3, 3)] * 4, "doc_id_a long, doc_id_b long")).count() == 0
    assert records(jaccard.components(spark.createDataFrame([(2, 1)] * 3 + [(1, 2)], "doc_id_a long, doc_id_b long")), "id", "root") == [(2, 1)]


def test_query_counts_all_links(spark, tmp_path):
    rng = random.Random(3)
    rows, n = [], 0
    for size in [1] * 20 + [4] * 10 + [60]:
        base = [f"v{rng.randint(0, 3000)}" for _ in range(rng.randint(30, 90))]
        near = [f"v{rng.randint(0, 3000)}" if rng.random() < 0.03 else w for w in base]
        for text in [base] * size + [near] * (size - 1):
            rows.append((n := n + 1, " ".join(text)))
    rows += [(n := n + 1, ""), (n := n + 1, None)]
    rng.shuffle(rows)
    docs(spark, [(i, t, "s") for i, t in rows]).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in jaccard.query(spark, str(tmp_path)).collect()]
    want = brute_classes(rows, brute(rows))
    assert sorted(x[0] for x in got) == sorted(i for i, _ in rows)
    assert sum(x[2] for x in got) >= 0.9 * sum(x[2] for x in want) and len(set(got) & set(want)) >= 0.9 * len(want)
    # what isn't in doubt: no link that isn't there, and all between copies
    links = {x[0]: x[2] for x in want}
    assert all(x[2] <= links[x[0]] for x in got)


def test_ids_with_several_sets(spark):
    one, two, three, near = " ".join(f"a{i}" for i in range(30)), " ".join(f"a{i}" for i in range(28)), "x y z u v w", "x y z u v w q"
    rows = [(1, one), (1, three), (2, one), (3, two), (4, three), (4, three), (5, one), (6, one), (6, two), (8, "all alone here"), (7, near)]
    got = records(jaccard.classes(docs(spark, [(i, t, "s") for i, t in rows])), "doc_id", "class_id", "n_links")
    # one: 1 2 5 6; two: 3 6; three: 1 4; near: 7. A similar set counts with all that have it.
    one_, two_, three_, near_ = 3 + 2, 1 + 4, 1 + 1, 2
    assert got == [(1, 1, one_ + three_), (2, 1, one_), (3, 1, two_), (4, 1, three_), (5, 1, one_), (6, 1, one_ + two_), (7, 1, near_), (8, 8, 0)]
    # two texts of one document are no pair, and what is found for one isn't put down to the other
    own = [(6, "p q r s t u v w"), (6, "p q r s t u v z"), (7, "k l m n")]
    assert records(jaccard.classes(docs(spark, [(i, t, "s") for i, t in own])), "doc_id", "class_id", "n_links") == [(6, 6, 0), (7, 7, 0)]
    shared = " ".join(f"b{i}" for i in range(20))
    pairs = jaccard.jaccard_join(docs(spark, [(6, shared, "s"), (6, one, "s"), (7, shared + " end", "s"), (7, "other words", "s")]))
    assert [(a, b, round(s, 6)) for a, b, s in records(pairs, "doc_id_a", "doc_id_b", "jaccard")] == [(6, 7, round(18 / 19, 6))]


def test_classes_awkward(spark):
    got = records(jaccard.classes(docs(spark, AWKWARD)), "doc_id", "class_id", "n_links")
    assert got == [(1, 1, 0), (2, 2, 0), (3, 3, 0), (5, 5, 0), (6, 6, 1), (7, 6, 1), (8, 8, 0)]
    assert jaccard.classes(docs(spark, AWKWARD).limit(0)).count() == 0


def test_hot_buckets_are_split_and_meet_in_blocks(spark, monkeypatch):
    """Buckets above HOT go down by exchanges, and what no split parts meets in blocks."""
    monkeypatch.setattr(jaccard, "HOT", 8)
    monkeypatch.setattr(jaccard, "LEAF", 4)
    rng = random.Random(11)
    rows, n = [], 0
    for size in [1] * 40 + [30, 50]:
        base = [f"v{rng.randint(0, 3000)}" for _ in range(60)]
        for _ in range(size):
            rows.append((n := n + 1, " ".join(f"v{rng.randint(0, 3000)}" if rng.random() < 0.02 else w for w in base)))
    check(spark, rows)
    sets = jaccard.signatures(docs(spark, [(i, t, "s") for i, t in rows]), 3, 0.5, 0.95)
    sizes = [r["count"] for r in jaccard.split(sets, jaccard.branches(0.5)).groupBy("bucket").count().collect()]
    assert 8 < max(sizes) <= 40


def test_a_pair_survives_at_any_depth():
    for threshold in (0.3, 0.5, 0.8, 1.0):
        p = jaccard.survival(threshold)
        assert p > 0.5 and 1 - (1 - p) ** jaccard.runs_for(threshold, 0.95) >= 0.95
        assert abs(p - (1 - (1 - threshold * p) ** jaccard.branches(threshold))) < 1e-6


def test_sets_that_nothing_parts(spark):
    values = np.zeros((600, jaccard.WIDTH), np.uint16)
    values[:, 0] = np.arange(600)
    pairs = jaccard.join_bucket(values, np.arange(600), 0.4, 3, 1)
    assert sum(len(a) for a, _ in pairs) == 600 * 599 // 2


def cluster(rng, sizes, far):
    """Texts of near copies of one base, and of others that resemble it by half only."""
    base, new = [f"v{i}" for i in range(80)], lambda: f"n{rng.randint(0, 10**6)}"
    near = [[new() if rng.random() < 0.02 else w for w in base] for _ in range(sizes)]
    half = [base[:58] + [new() for _ in range(22)] for _ in range(far)]
    return [" ".join(w) for w in near + half]


@pytest.mark.parametrize(("leaf", "hot"), [(256, 4096), (16, 64)])
def test_a_large_cluster_is_counted_whole_without_its_pairs(spark, monkeypatch, leaf, hot):
    """The pairs of near copies grow as the square of their number; none of a ball's is listed."""
    monkeypatch.setattr(jaccard, "LEAF", leaf)
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 100, raising=False)
    rng = random.Random(8)
    texts = cluster(rng, 420, 30) + [" ".join(f"o{rng.randint(0, 10**6)}" for _ in range(40)) for _ in range(30)]
    rows = [(i, t, "s") for i, t in enumerate(texts + texts[:25])]
    rng.shuffle(rows)
    table = docs(spark, rows).repartition(3)
    pairs = brute([(i, t) for i, t, _ in rows])
    want = brute_classes([(i, t) for i, t, _ in rows], pairs)
    near = jaccard.compared(table, 0.5, 3, 0.95)[1]
    assert near.count() < len(pairs) / 4
    got = sorted(records(jaccard.classes(table), "doc_id", "class_id", "n_links"))
    assert [x[:2] for x in got] == [x[:2] for x in want]
    most = {i: k for i, _, k in want}
    assert all(k <= most[i] for i, _, k in got) and sum(k for *_, k in got) >= 0.99 * sum(most.values())
    listed = unfolded({(r.doc_id_a, r.doc_id_b): r.jaccard for r in jaccard.jaccard_join(table).collect()})
    assert all(abs(pairs[p] - s) < 1e-9 for p, s in listed.items()) and len(listed) >= 0.99 * len(pairs)
    kept = sorted(r.doc_id for r in jaccard.keep_one(table).select("doc_id").collect())
    assert kept == sorted({c for _, c, _ in want})


def test_documents_of_several_sets_beside_a_ball(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAF", 8)
    texts = cluster(random.Random(4), 60, 0)
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(5, texts[0].replace("v9", "else"), "s"), (70, texts[7], "s"), (70, texts[8], "s"), (6, texts[6], "s")]
    got = {i: (c, k) for i, c, k in records(jaccard.classes(docs(spark, rows)), "doc_id", "class_id", "n_links")}
    sets, held = {}, {}
    for i, t, _ in rows:
        sets.setdefault(frozenset(grams(t)), set()).add(i)
        held.setdefault(i, set()).add(frozenset(grams(t)))
    first = {s: min(ids) for s, ids in sets.items()}
    like = {s: [o for o in sets if o != s and first[o] != first[s] and len(o & s) >= 0.5 * len(o | s)] for s in sets}
    want = {i: sum(len(sets[s]) - 1 + sum(len(sets[o]) for o in like[s]) for s in own) for i, own in held.items()}
    assert {i: k for i, (_, k) in got.items()} == want and {c for c, _ in got.values()} == {0}


def test_shared_counts_and_roots():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    sets = [np.unique(np.where(rng.random(300) < rng.choice([0, 0.1, 1]), rng.integers(0, 900, 300).astype(np.uint64), base)) for _ in range(60)]
    want = [[len(np.intersect1d(x, y)) for y in sets[40:]] for x in sets[:40]]
    assert jaccard.shared(sets[:40], sets[40:]).tolist() == want
    linked = np.zeros((7, 7), bool)
    for a, b in [(1, 4), (4, 2), (3, 6)]:
        linked[a, b] = linked[b, a] = True
    assert jaccard.roots(linked).tolist() == [0, 1, 1, 3, 1, 5, 3]


def test_few_pairs_are_held_at_a_time():
    values = np.zeros((3000, jaccard.WIDTH), np.uint16)
    sizes = [len(a) for a, _ in jaccard.join_bucket(values, np.arange(3000), 0.4, 3, 1)]
    assert sum(sizes) == 3000 * 2999 // 2 and max(sizes) < 3000
    assert not isinstance(jaccard.join_bucket(values, np.arange(3000), 0.4, 3, 1), list)
    ball = np.repeat([1, 1, 2], 1000)
    assert sum(len(a) for a, _ in jaccard.join_bucket(values, np.arange(3000), 0.4, 3, 1, ball=ball)) == 2000 * 1000
