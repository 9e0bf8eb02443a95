import json
import os

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from duotext import runtime, schema
from duotext.operators import learning, pairs
from duotext.plans import recipes
from duotext.sources import artifacts, readers, versions

ROWS = [("ctx", "first", "0"), ("", "empty context", "2"), (None, "no context", "1"), ("ctx", "first", "0")]


def jsonl(path, rows=ROWS, extra=""):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        for c, t, label in rows:
            f.write(json.dumps({"context": c, "target": t, "label": label}) + "\n")
        f.write(extra)
    return path


def test_jsonl(spark, tmp_path):
    df = readers.read_jsonl(spark, jsonl(f"{tmp_path}/a/train.jsonl", extra="\n\n"))
    assert df.schema == schema.PAIR_SCHEMA
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, ROWS))


def test_malformed_line_fails(spark, tmp_path):
    path = jsonl(f"{tmp_path}/a/train.jsonl", extra="{broken\n")
    with pytest.raises((PySparkException, Py4JJavaError)):
        readers.read_jsonl(spark, path).collect()


def test_annotated_csv(spark, tmp_path):
    path = f"{tmp_path}/test.csv"
    with open(path, "w") as f:
        f.write('id,context,target,human annotation,note\n1,"a ""quoted"" one","two\nlines",h,x\n2,"comma, here",plain,other,y\n3,c,d,c,z\n4,,e,,z\n')
    columns = ["id", "context", "target", "human annotation", "note"]
    df = readers.read_annotated_csv(spark, path, columns, columns[1:4], {"human annotation": "label"})
    assert df.columns == ["context", "target", "label"]
    assert df.first()["context"] == 'a "quoted" one' and df.first()["target"] == "two\nlines"
    out = recipes.prepare_annotated_test(df)
    assert [(r["target"], r["label"]) for r in out.collect()] == [("two\nlines", 0), ("d", 1)]
    with pytest.raises((PySparkException, Py4JJavaError)):  # a header that does not match
        readers.read_annotated_csv(spark, path, list(reversed(columns)), columns[:1]).collect()


def test_csv_splits(spark, tmp_path):
    files = {}
    for split, n in (("train", 3), ("validation", 1)):
        files[split] = f"{tmp_path}/{split}.csv"
        with open(files[split], "w") as f:
            f.write("all_text,label\n" + "".join(f"parent [SEP] child {i},{i}\n" for i in range(n)))
    df = readers.read_csv_splits(spark, files)
    assert {r["split"]: r["count"] for r in df.groupBy("split").count().collect()} == {"train": 3, "validation": 1}
    assert df.schema["label"].dataType.simpleString() == "int"


def test_tiers_prune_whole_files(spark, tmp_path):
    for tier, split in schema.TIER_SPLITS:
        jsonl(f"{tmp_path}/{tier}/{split}.jsonl")
    df = readers.read_tiered(spark, str(tmp_path))
    assert df.count() == 5 * len(ROWS)
    only = df.where("tier = 'gold' and split = 'test'")
    assert only.count() == len(ROWS)
    assert only._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_artifacts(spark, tmp_path):
    path = f"{tmp_path}/table"
    df = spark.range(3).withColumn("input_ids", F.array(F.lit(1), F.lit(2)))
    artifacts.write_artifact(df, path)
    with pytest.raises((PySparkException, Py4JJavaError)):
        artifacts.write_artifact(df, path)
    artifacts.write_artifact(df.limit(1), path, overwrite=True)
    assert artifacts.read_artifact(spark, path).count() == 1


def test_materialize_once(spark, tmp_path):
    path, calls = f"{tmp_path}/once", []

    def compute():
        calls.append(1)
        return spark.range(len(calls))

    def get(**kw):
        return artifacts.materialize_if_absent(spark, path, compute, **kw).count()

    assert [get(), get(), get(overwrite=True)] == [1, 1, 2]
    os.unlink(f"{path}/_SUCCESS")  # the rest of a failed write
    assert get() == 3


def test_recipe_partitions(spark, tmp_path):
    root = f"{tmp_path}/store"
    for n, tier in ((2, "gold"), (3, "silver")):
        artifacts.write_recipe(spark.range(n), root, tier, "train")
    artifacts.write_recipe(spark.range(5), root, "gold", "train")  # replaces its own partition only
    assert artifacts.read_recipe(spark, root, tier="gold").count() == 5
    assert artifacts.read_recipe(spark, root, tier="silver", null_ratio=0.0).count() == 3
    plan = artifacts.read_recipe(spark, root, tier="gold")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tier" in plan
    with pytest.raises(ValueError):
        artifacts.read_recipe(spark, root, colour="red")


def test_shared_folder_is_the_configured_one(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert runtime.shared_dir(spark) == folder
    df = runtime.cut_lineage(spark.range(4).withColumn("x", F.col("id") * 2))
    assert df.count() == 4
    assert all(folder in f for f in df.inputFiles())


def corpus(tmp_path):
    rows = [(f"context {i % 5}", f"target number {i}", str(i % 3)) for i in range(30)] + [("context 0", "target number 0", "0")] * 3
    jsonl(f"{tmp_path}/data/gold/train.jsonl", rows)
    return f"{tmp_path}/data", f"{tmp_path}/store", rows


def test_prepare(spark, tmp_path):
    root, store, rows = corpus(tmp_path)
    out = recipes.prepare(spark, root, store, "gold", "train", upsampling=True, null_ratio=0.25, max_length=16)
    n0 = sum(r[2] != "2" for r in rows)
    tokens = out["tokens"]
    (encoding,) = [n for n in os.listdir(store) if n.startswith("gold_train_")]
    words = recipes.load_encoding(spark, f"{store}/{encoding}")
    assert recipes.read_prepared(spark, words, tier="gold", upsampled=True, null_ratio=0.25).count() == tokens.count()
    assert recipes.read_prepared(spark, words, "hidden").drop("tier", "split", "num_label", "upsampled", "null_ratio").columns == out["hidden"].columns
    assert recipes.read_prepared(spark, words, num_label=3).count() == 0
    assert tokens.count() == 2 * n0 == out["hidden"].count()
    assert tokens.where("context = ''").count() == int(0.25 * 2 * n0)
    assert tokens.where("size(input_ids) <> 16 or size(attention_mask) <> 16").count() == 0
    assert out["hidden"].where("size(hidden_state) <> 768").count() == 0


def test_prepare_reuses_and_overwrites(spark, tmp_path):
    root, store, rows = corpus(tmp_path)

    def run(**kw):
        return recipes.prepare(spark, root, store, "gold", "train", num_label=3, output_vectors=False, max_length=16, **kw)["tokens"]

    first = run()
    assert first.count() == len(rows) and run().inputFiles() == first.inputFiles()
    jsonl(f"{root}/gold/train.jsonl", rows[:4])  # a changed file is prepared again
    assert run().count() == 4
    assert run(overwrite=True).inputFiles() != run(overwrite=True).inputFiles()


def test_one_encoding_for_all_splits(spark, tmp_path):
    root, store, rows = corpus(tmp_path)
    jsonl(f"{root}/gold/val.jsonl", [("context 1", "target unseen 3", "0"), ("context 2", "number 3", "2")])
    encoding = recipes.fit_encoding(recipes.keyed_source(spark, root, store, "gold", "train"), store, "words")
    made = {s: recipes.prepare(spark, root, store, "gold", s, encoding, max_length=16) for s in ("train", "val")}
    ids = {r["token"]: r["id"] for r in encoding.vocab.collect()}
    first = {r["target"]: r["input_ids"] for r in made["val"]["tokens"].collect()}
    assert first["target unseen 3"][1:4] == [ids["target"], 3, ids["3"]] and first["number 3"][1:3] == [ids["number"], ids["3"]]
    # the vectors of both splits are weighed by the training rows: a text gives the same vector wherever it is
    text = spark.createDataFrame([("context 1", "target unseen 3")], "context string, target string")
    alone = learning.embed_rows(pairs.pair_text(text), idf=encoding.idf).first()["hidden_state"]
    assert alone in [r["hidden_state"] for r in made["val"]["hidden"].collect()]
    with pytest.raises(ValueError, match="in use"):
        recipes.fit_encoding(text, store, "words", overwrite=True)
    assert recipes.load_encoding(spark, f"{store}/words").vocab.count() == len(ids)


def test_recipes_share_one_keyed_source(spark, tmp_path):
    root, store, rows = corpus(tmp_path)
    source = recipes.keyed_source(spark, root, store, "gold", "train")
    os.unlink(f"{root}/gold/train.jsonl")
    for n in (2, 3):
        made = recipes.prepare(spark, root, store, "gold", "train", num_label=n, output_vectors=False, max_length=16)
        assert made["tokens"].count() == source.count() == len(rows)


def test_versions_follow_their_inputs(spark, tmp_path):
    path, calls = f"{tmp_path}/table", []
    given = [str(tmp_path / "in")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one")

    def compute():
        calls.append(1)
        return spark.range(len(calls))

    def get(recipe="x", **kw):
        return versions.materialize(spark, path, compute, given, {"name": recipe}, **kw).count()

    assert [get(), get(), get(overwrite=True), get()] == [1, 1, 2, 2]
    (tmp_path / "in" / "a.txt").write_text("longer")
    assert [get(), get()] == [3, 3]
    (tmp_path / "in" / "_hidden").write_text("no input")
    assert get() == 3 and get("y") == 4
    newest = versions.versions(spark, path)
    assert len(newest) == versions.KEPT
    made = versions.manifest(spark, newest[-1])
    assert made["recipe"] == {"name": "y"} and [f[1] for f in made["inputs"]] == [6]
    os.rename(tmp_path / "in", tmp_path / "gone")
    assert get("y") == 4  # what there is, since it can't be made again
    with pytest.raises(FileNotFoundError):
        get("z")


def test_a_failed_write_leaves_the_table(spark, tmp_path):
    path = f"{tmp_path}/table"
    (tmp_path / "in").write_text("one")
    assert versions.materialize(spark, path, lambda: spark.range(3), [f"{tmp_path}/in"]).count() == 3
    before = versions.versions(spark, path)
    (tmp_path / "in").write_text("other")
    with pytest.raises((PySparkException, Py4JJavaError)):
        versions.materialize(spark, path, lambda: spark.range(5).select(F.raise_error(F.lit("killed")).cast("int").alias("id")), [f"{tmp_path}/in"])
    assert versions.versions(spark, path) == before and spark.read.parquet(before[-1]).count() == 3

    def changes_its_input():
        (tmp_path / "in").write_text("changed meanwhile")
        return spark.range(9)

    with pytest.raises(RuntimeError, match="changed"):
        versions.materialize(spark, path, changes_its_input, [f"{tmp_path}/in"])
    assert versions.versions(spark, path) == before


def test_whole_rows_are_read_once_per_class(spark, tmp_path):
    root, store, rows = corpus(tmp_path)
    source = recipes.keyed_source(spark, root, store, "gold", "train")
    keys = runtime.cut_lineage(source.select("row_id", "label"))
    whole = recipes.prepare_pairs(source, True, null_ratio=0.25, keys=keys)
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 3  # each class of the source, and the draws
    plain = recipes.prepare_pairs(source, True, null_ratio=0.25)
    assert sorted(map(str, whole.collect())) == sorted(map(str, plain.select(*whole.columns).collect()))


def test_csv_lines_can_be_split(spark, tmp_path):
    (tmp_path / "x.csv").write_text('all_text,label\n"a, ""b""",1\nc,0\n')
    read = readers.read_csv_splits(spark, {"train": str(tmp_path / "x.csv")}, multi_line=False)
    assert sorted((r["all_text"], r["label"]) for r in read.collect()) == [('a, "b"', 1), ("c", 0)]
    (tmp_path / "y.csv").write_text('all_text,label\n"a\nb",1\n')
    with pytest.raises(Exception):
        readers.read_csv_splits(spark, {"train": str(tmp_path / "y.csv")}, multi_line=False).collect()
    assert readers.read_csv_splits(spark, {"train": str(tmp_path / "y.csv")}).first()["all_text"] == "a\nb"


@pytest.fixture
def small_ranges(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(n) for n in names]
    yield lambda size: [spark.conf.set(n, v) for n, v in zip(names, (size, 0), strict=True)]
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


WORDS = ["", "plain", "comma, here", 'a "quoted" one', "two\nlines", "\n", "\n\n\n", '"', '""', 'x"\n"y', "é\r\n😀", "long " * 30, "one\n" * 40, " edge "]


@pytest.mark.parametrize("size,broadcast", [(40, True), (300, False), (1 << 27, True)])
def test_records_of_any_range_size(spark, tmp_path, small_ranges, monkeypatch, size, broadcast):
    import csv
    import random

    from duotext.sources import csv_records

    rnd = random.Random(size)
    rows = [(str(i), rnd.choice(WORDS), rnd.choice(WORDS)) for i in range(36)]
    for part in range(3):
        for end, name in (("\n", "lf"), ("\r\n", "crlf")):
            with open(tmp_path / f"{name}-{part}.csv", "w", newline="") as f:
                out = csv.writer(f, lineterminator=end, quoting=[csv.QUOTE_MINIMAL, csv.QUOTE_ALL, csv.QUOTE_MINIMAL][part])
                out.writerows([("id", "first one", "second"), *rows[12 * part:12 * part + 12]])
    small_ranges(size)
    if not broadcast:
        monkeypatch.setattr(csv_records, "RANGES", 0)
    found = csv_records.read_records(spark, str(tmp_path), schema.T.StructType.fromDDL("id string, `first one` string, second string"))
    assert found.columns == ["id", "first one", "second"]
    got = sorted(tuple("" if v is None else v for v in r) for r in found.collect())
    assert got == sorted(rows + rows)
    assert size > 40 or csv_records._lines(spark, str(tmp_path)).rdd.getNumPartitions() > 60


def test_records_equal_the_whole_file_reader(spark, sf_dir, tmp_path, small_ranges):
    from duotext.sources import csv_records

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs.coalesce(1).write.option("header", True).option("escape", '"').csv(f"{tmp_path}/docs")
    plain = spark.read.schema(docs.schema).option("header", True).option("multiLine", True).option("escape", '"').csv(f"{tmp_path}/docs")
    expected = sorted(map(str, plain.collect()))
    small_ranges(100_000)
    found = csv_records.read_records(spark, f"{tmp_path}/docs", docs.schema)
    assert sorted(map(str, found.collect())) == expected
    assert csv_records._lines(spark, f"{tmp_path}/docs").rdd.getNumPartitions() > 10


@pytest.mark.parametrize("content", ['a,b\n"x\ny,1\n', "b,a\nx,1\n", "a,b\nx,y\n", "a,b\nx,1,2,3\n"])
def test_broken_records_fail(spark, tmp_path, content):
    from duotext.sources import csv_records

    (tmp_path / "x.csv").write_text(content)
    with pytest.raises((PySparkException, Py4JJavaError)):
        csv_records.read_records(spark, str(tmp_path), schema.T.StructType.fromDDL("a string, b int")).collect()


def test_no_records(spark, tmp_path):
    from duotext.sources import csv_records

    (tmp_path / "x.csv").write_text("a,b\n")
    assert csv_records.read_records(spark, str(tmp_path), schema.T.StructType.fromDDL("a string, b int")).count() == 0


def test_recipe_values_keep_their_types(spark, tmp_path):
    artifacts.write_recipe(spark.range(2), f"{tmp_path}/s", "1", "train", upsampled=True)
    row = artifacts.read_recipe(spark, f"{tmp_path}/s", tier="1", upsampled=True).first()
    assert (row["tier"], row["upsampled"], row["num_label"], row["null_ratio"]) == ("1", True, 2, 0.0)


def test_prepare_with_a_model(spark, tmp_path):
    root, store, rows = corpus(tmp_path)

    def make():
        return lambda input_ids, attention_mask: input_ids[:, :2].astype("float32")

    out = recipes.prepare(spark, root, store, "gold", "train", max_length=16, make_predict_fn=make)
    assert out["hidden"].count() == len(rows)
    assert all(r["hidden_state"][0] == 0.0 for r in out["hidden"].collect())


@pytest.mark.parametrize("args, name", [
    (("gold", "train", False, 2, 0.0), "gold_2-label_train"),
    (("silver", "val", False, 3, 0.25), "silver_null_context_3-label_val"),
    (("gold", "train", True, 2, 0.0), "gold_upsample_2-label_train"),
])
def test_recipe_names(args, name):
    assert recipes.recipe_name(*args) == name
