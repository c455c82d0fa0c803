"""The extractor, training, streaming and files."""

import math
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from gleaner import shipping
from gleaner.operators import blocks, features, labels, model, parse
from gleaner.plans import queries
from gleaner.sources import files
from gleaner.streaming import extract as streaming

SF = "/root/testdata/sf0.001"


def test_extract_is_its_parts(spark):
    pages = queries.pages(spark, SF)
    got = {r.page_id: r.content for r in model.extract_content(pages).collect()}
    rows = features.readability(features.kohlschuetter(features.weninger(blocks.blocks(pages, tolerant=True)))).orderBy("page_id", "block_idx").collect()
    want = {k: [] for k in got}
    for r in rows:
        z = model.DEFAULT.intercept + sum(w * r[c] for c, w in zip(model.DEFAULT.columns, model.DEFAULT.weights))
        if 1 / (1 + math.exp(-z)) > 0.5:
            want[r.page_id].append(r.text)
    assert got == {k: "\n".join(v) for k, v in want.items()}
    assert sum(map(bool, got.values())) > 25


def test_comments_need_a_model(spark, tmp_path, monkeypatch):
    pages = queries.pages(spark, SF)
    monkeypatch.setattr(model, "MODELS", model.Models())
    for extract in (model.extract_comments, model.extract_content_and_comments):
        with pytest.raises(LookupError):
            extract(pages)
    blocks_, gold = queries.tolerant_blocks(spark, SF).persist(), queries.gold_texts(spark, SF)
    found = labels.block_labels(labels.gold_blocks(blocks_, gold)).persist()
    for name in ("comments", "content_and_comments"):
        start = model.Extractor(to_extract=tuple(name.split("_and_")), max_block_weight=50, cap_weights=True, prob_threshold=0.2)
        start.with_model(model.fit_logistic(start, blocks_, found)).save(spark, str(tmp_path / name))
        model.MODELS.paths[name] = str(tmp_path / name)
    content = {r.page_id: r.content for r in model.extract_content(pages).collect()}
    comments = {r.page_id: r.content for r in model.extract_comments(pages).collect()}
    both = {r.page_id: r.content for r in model.extract_content_and_comments(pages).collect()}
    assert model.MODELS.made["comments"].prob_threshold == 0.2
    said = {r.page_id: r.comments for r in gold.collect()}
    holds = lambda made: sum(said[k] in made[k] for k in said)
    assert holds(comments) > 40 and holds(both) > 25 and holds(content) < 10
    assert content != both and all(comments[k] != content[k] for k in content)
    assert (model.MODELS.made["comments"].max_block_weight, model.MODELS.made["comments"].cap_weights) == (50, True)
    model.MODELS.paths["content"] = str(tmp_path / "comments")
    model.MODELS.made.clear()
    with pytest.raises(ValueError):
        model.extract_content(pages)
    with pytest.raises(ValueError):
        model.Extractor(features=[("mine", "css")]).save(spark, str(tmp_path / "css"))


def test_labels_and_weights(spark):
    rows = blocks.blocks(spark.createDataFrame([(1, "<p>main text of it</p><p>menu</p><p>said by me</p>"), (2, "<p>x</p>")], "page_id long, html string"), tolerant=True)
    gold = spark.createDataFrame([(1, "main text of it", "said by me")], "page_id long, content string, comments string")
    got = model.Extractor(to_extract=("content", "comments")).labels_and_weights(rows, gold).orderBy("block_idx").select("text", "label", "weight").collect()
    assert [tuple(r) for r in got] == [("main text of it", 1.0, 4.0), ("menu", 0.0, 1.0), ("said by me", 1.0, 3.0)]


def test_the_package_goes_to_executors(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {str(shipping.ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", {str(tmp_path / "w")!r}).getOrCreate()
import __spark_entry__ as e
print("ROWS", e.queries()["min_depths"](spark, {SF!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 569" in done.stdout, done.stderr[-2000:]


def test_small_pages_give_nothing(spark):
    pages = spark.createDataFrame([(1, "<p>one</p><p>two</p>"), (2, ""), (3, None)], "page_id long, html string")
    assert [r.content for r in model.extract_content(pages).collect()] == ["", "", ""]


def test_bad_arguments():
    with pytest.raises(TypeError):
        model.Extractor(model=3)
    with pytest.raises(ValueError):
        model.Extractor(to_extract="title")
    assert model.model_name(["b", "a"], ("comments", "content")) == "a_b_comments_content"


def test_weights_and_targets(spark):
    gold = spark.createDataFrame([(1, 0, 1, 0, 500), (1, 1, 0, 1, 3)], "page_id long, block_idx int, content int, comments int, weight int")
    both = model.Extractor(to_extract=("content", "comments")).targets_of(gold)
    assert {(r.label, r.weight) for r in both.collect()} == {(1.0, 500.0), (1.0, 3.0)}
    capped = model.Extractor(cap_weights=True).targets_of(gold)
    assert {(r.label, r.weight) for r in capped.collect()} == {(1.0, 200.0), (0.0, 3.0)}


def test_training_round_trip(spark, tmp_path):
    pages = queries.pages(spark, SF)
    gold = labels.block_labels(labels.gold_blocks(queries.tolerant_blocks(spark, SF), queries.gold_texts(spark, SF))).persist()
    start = model.Extractor(model=model.forest(trees=3, least=5))
    fitted, report = model.train_model(start, pages, gold, output=str(tmp_path))
    scores = {r.in_train: r.f1 for r in report.collect()}
    assert scores[True] > 0.8 and scores[False] > 0.7
    again = model.Extractor.load(spark, f"{tmp_path}/kohlschuetter_readability_weninger_content")
    assert (again.names, again.targets, again.prob_threshold) == (start.names, start.targets, start.prob_threshold)
    assert sorted(again.extract(pages).collect()) == sorted(fitted.extract(pages).collect())
    assert spark.read.json(f"{tmp_path}/*_block_errors").count() == 2


def test_training_makes_labels_once(spark):
    pages, made = queries.pages(spark, SF), spark.sparkContext.accumulator(0)
    gold = labels.block_labels(labels.gold_blocks(queries.tolerant_blocks(spark, SF), queries.gold_texts(spark, SF))).persist()

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    again = gold.mapInArrow(counted, gold.schema)
    model.train_model(model.Extractor(model=model.forest(trees=2, least=5)), pages, again)[1].collect()
    assert made.value == gold.count()


def test_kinds_are_parsed_once(spark, monkeypatch):
    times, parsed = [], parse.raw_blocks
    monkeypatch.setattr(parse, "raw_blocks", lambda *a, **k: times.append(1) or parsed(*a, **k))
    got = {r.page_id: r for r in queries.extracted_kinds(spark, SF).collect()}
    assert len(times) == 1
    content = {r.page_id: r.content for r in model.extract_content(queries.pages(spark, SF)).collect()}
    assert {k: r.content for k, r in got.items()} == content
    assert sum(r.comments != "" for r in got.values()) > 40


def test_kinds_share_features(spark):
    some = {"content": model.Extractor(), "comments": model.Extractor(features="kohlschuetter", to_extract="comments")}
    with pytest.raises(ValueError):
        model.extract_kinds(queries.pages(spark, SF), queries.tolerant_blocks(spark, SF), some)


def test_grid(spark):
    from pyspark.ml.classification import LogisticRegression

    gold = labels.block_labels(labels.gold_blocks(queries.tolerant_blocks(spark, SF), queries.gold_texts(spark, SF))).persist()
    start = model.Extractor(features="kohlschuetter", model=LogisticRegression(maxIter=5))
    best, scores = model.train_many_models(start, {"regParam": [0.01, 10.0]}, queries.pages(spark, SF), gold, folds=2)
    assert len(scores) == 2 and best.model.predict is not None


def test_split_ignores_partitions(spark):
    pages = queries.pages(spark, SF)
    a = sorted(model.split_pages(pages).collect())
    assert a == sorted(model.split_pages(pages.repartition(5)).collect())
    assert 0.6 < sum(r.in_train for r in a) / len(a) < 0.95


def test_stream(spark, tmp_path):
    pages = queries.table(spark, SF, "pages")
    source = tmp_path / "in"
    pages.repartition(3).write.parquet(str(source))
    for _ in range(2):  # the second start finds nothing new
        q = streaming.extract_stream(streaming.page_stream(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "state"))
        q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("page_id", "content").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, model.extract_content(pages).collect()))
    raw = streaming.raw_block_stream(streaming.page_stream(spark, str(source)))
    assert raw.isStreaming and "start_tag" in raw.columns


def test_stream_of_a_folder_of_files(spark, tmp_path):
    pages = queries.table(spark, SF, "pages").limit(9)
    pages.repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.streamed_content(spark, str(tmp_path)).collect()
    assert sorted(got) == sorted(model.extract_content(pages.select("page_id", "html")).collect()) and len(got) == 9


def test_files(spark, tmp_path):
    (tmp_path / "b.html").write_bytes(" caf\xe9 ".encode("latin-1"))
    (tmp_path / "a.html").write_bytes("报".encode())
    (tmp_path / "n.txt").write_text("x")
    names = lambda **o: [r.path.rsplit("/", 1)[-1] for r in files.list_files(spark, str(tmp_path), **o).collect()]
    assert names() == ["a.html", "b.html", "n.txt"]
    assert names(extension="html", full_path=False) == ["a.html", "b.html"] and names(match="^[bn]") == ["b.html", "n.txt"]
    with pytest.raises(OSError):
        files.list_files(spark, str(tmp_path / "none")).collect()
    (tmp_path / "c.html").write_bytes(b"")
    (tmp_path / "d.html").write_bytes("\n\t\u00a0x y\u2003\n".encode())
    assert names(extension=".html", full_path=False) == ["a.html", "b.html", "c.html", "d.html"]
    assert sorted(map(tuple, files.read_html(spark, str(tmp_path)).collect())) == [("a", "报"), ("b", "caf\xe9"), ("c", ""), ("d", "x y")]


def test_gold_files(spark, tmp_path):
    for name, data in (("u8", "Gr\xfc\xdfe\n!@#$%^&*()   COMMENTS\nja"), ("u16", "Gr\xfc\xdfe\n!@#$%^&*() COMMENTS\nja"), ("l1", "Gr\xfc\xdfe"), ("none", "")):
        encoding = {"u16": "utf-16", "l1": "latin-1"}.get(name, "utf-8")
        (tmp_path / f"{name}.html.corrected.txt").write_bytes(data.encode(encoding))
    got = {r.page_id: (r.content, r.comments) for r in files.read_gold_texts(spark, str(tmp_path)).collect()}
    assert got == {"u8": ("Gr\xfc\xdfe", "ja"), "u16": ("Gr\xfc\xdfe", "ja"), "l1": ("Gr\xfc\xdfe", ""), "none": ("", "")}
    tagged = files.read_gold_texts(spark, str(tmp_path), tagged=True).filter("page_id = 'l1'").first()
    assert (tagged.content, tagged.comments) == ("Gr\xfc\xdfe", "")


def test_gold_block_files(spark, tmp_path):
    rows = spark.createDataFrame([("p", 0, 0.5, 0.0, ["a", "b"], ["a"], []), ("p", 1, 0.0, 1.0, ["c"], [], ["c"])], "page_id string, block_idx int, frac_content double, frac_comments double, block_tokens array<string>, content_tokens array<string>, comment_tokens array<string>")
    files.write_gold_blocks(rows, str(tmp_path / "pq"))
    assert sorted(spark.read.parquet(str(tmp_path / "pq")).collect()) == sorted(rows.collect())
    files.write_gold_blocks_tsv(rows, str(tmp_path / "tsv"))
    back = files.read_gold_blocks_tsv(spark, str(tmp_path / "tsv/page_id=p/*.csv")).orderBy("block_idx").select(*rows.columns[1:]).collect()
    assert back == rows.orderBy("block_idx").select(*rows.columns[1:]).collect()
    assert files.read_gold_blocks_tsv(spark, str(tmp_path / "tsv/page_id=p/*.csv"), split_blocks=False).count() == 2
