"""Readers, writers and streams on files of their own."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.sources import readers, writers
from textloom.streaming import ingest


def test_csv_round_trip_with_quotes_and_breaks(spark, tmp_path):
    rows = [("a \"quoted\", text\nwith a break", "Yes"), ("plain", "No"), ("NA", None)]
    df = spark.createDataFrame(rows, "Text string, class_label string")
    writers.write_csv(df, f"{tmp_path}/x")
    back = readers.delimited(spark, f"{tmp_path}/x", "Text string, class_label string", multi_line=True)
    assert sorted(map(str, back.collect())) == sorted(map(str, spark.createDataFrame([*rows[:2], (None, None)], df.schema).collect()))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        writers.write_csv(df, f"{tmp_path}/x")


def test_files_by_extension_and_name(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/seq_1_real_100_aug_8.csv").write_text("Text,class_label\na,Yes\nb,No\n")
    (tmp_path / "s/train.tsv").write_text("Text\tclass_label\nc\tYes\n")
    assert readers.by_extension(spark, str(tmp_path), "Text string, class_label string").count() == 3
    got = readers.sequence_files(spark, str(tmp_path), "Text string, class_label string").select("Text", "seq", "base", "aug").collect()
    assert sorted(map(tuple, got)) == [("a", 1, 100, 8), ("b", 1, 100, 8)]


def test_tolerant_and_json(spark, tmp_path):
    (tmp_path / "bad.tsv").write_text("id\tText\n1\ta\nx\tb\n2\tc\n")
    assert readers.delimited(spark, f"{tmp_path}/bad.tsv", "id int, Text string", sep="\t", tolerant=True).count() == 2
    (tmp_path / "l.json").write_text('[{"id": 1}, {"id": 2}]')
    assert readers.json_array(spark, f"{tmp_path}/l.json", "id int").count() == 2
    (tmp_path / "l.jsonl").write_text('{"guid": 1, "gold": 0}\n{"guid": 2, "gold": 1}\n')
    assert readers.json_lines(spark, f"{tmp_path}/l.jsonl", "guid long, gold int").agg(F.sum("gold")).first()[0] == 1


def test_arrays(spark, tmp_path):
    np.save(tmp_path / "logits.npy", np.array([[0.5, 1.5], [2.0, 3.0]], np.float32))
    assert [tuple(r) for r in readers.arrays(spark, str(tmp_path)).orderBy("row_id").collect()] == [("logits.npy", 0, [0.5, 1.5]), ("logits.npy", 1, [2.0, 3.0])]


def test_sequence_tree_and_artifact(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "a"), (1, 8, "b")], "seq int, aug int, Text string")
    writers.write_sequence(df, f"{tmp_path}/t")
    writers.write_sequence(df.where("aug = 8").withColumn("Text", F.lit("new")), f"{tmp_path}/t")
    assert sorted(r["Text"] for r in spark.read.parquet(f"{tmp_path}/t").collect()) == ["a", "new"]
    writers.write_artifact(df, str(tmp_path), "pool", 1)
    assert spark.read.json(f"{tmp_path}/manifest").first()["rows"] == 2
    with pytest.raises(ValueError):
        writers.write_artifact(df.where("false"), str(tmp_path), "pool", 2)


def test_run_catalogue(spark):
    runs = spark.createDataFrame([("r1", "g", "finished", 1, "a", 0, 2), ("r0", "g", "finished", 1, "a", 0, 1), ("r2", "g", "failed", 2, "a", 0, 1)], "name string, grp string, state string, seq int, aug string, seed int, created int")
    assert [r["name"] for r in readers.run_catalogue(runs, "g").collect()] == ["r0"]


def test_stream_appends_each_key_once(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(t, "a long enough text"), (t + dt.timedelta(minutes=1), "a long enough text"), (t, "short"), (t + dt.timedelta(minutes=2), "another text of some length")]
    spark.createDataFrame(rows, "at timestamp, Text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("at timestamp, Text string").parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        ingest.append_to(ingest.first_seen(ingest.valid_texts(stream), "Text", "at", "1 hour"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_one_broken_file_spoils_no_other(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.tsv").write_text("id\tText\n1\ta\n2\tb\n")
    (tmp_path / "d/b.tsv").write_text("id\tText\nx\ty\n3\tc\n")
    rows, failed = readers.isolated(spark, f"{tmp_path}/d", "id int, Text string")
    assert sorted(r["id"] for r in rows.collect()) == [1, 2, 3] and [tuple(r) for r in failed.collect()] == [("b.tsv", 1)]


def test_templates_and_properties(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p/one.txt").write_text("Write {n}\nclaims")
    assert [tuple(r) for r in readers.templates(spark, f"{tmp_path}/p").collect()] == [("one.txt", "Write {n}\nclaims")]
    (tmp_path / "x.json").write_text('{"topic": {"tax": ["fair", "low"]}, "tone": {"dry": []}}')
    got = {(r["category"], r["name"], tuple(r["features"])) for r in readers.properties(spark, f"{tmp_path}/x.json").collect()}
    assert got == {("topic", "tax", ("fair", "low")), ("tone", "dry", ())}


def test_splits_appends_epochs_predictions(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "a"), (2, 1, None)], "id int, epoch int, Text string")
    for s in ("train", "dev"):
        writers.write_csv(df.select("id", "Text"), f"{tmp_path}/{s}")
    got = readers.splits(spark, {s: f"{tmp_path}/{s}" for s in ("train", "dev")}, "id int, Text string")
    assert sorted((r["id"], r["split"], r["Text"] or "") for r in got.collect()) == [(1, "dev", "a"), (1, "train", "a"), (2, "dev", ""), (2, "train", "")]
    for _ in range(2):
        writers.append(df, f"{tmp_path}/a")
    assert spark.read.parquet(f"{tmp_path}/a").count() == 4
    writers.write_epochs(df, f"{tmp_path}/e")
    assert {(r["id"], r["epoch"]) for r in spark.read.json(f"{tmp_path}/e").collect()} == {(1, 0), (2, 1)}
    writers.write_splits(df, f"{tmp_path}/s", ("x", "y"))
    assert [spark.read.parquet(f"{tmp_path}/s/{x}").count() for x in "xy"] == [2, 2]
    runs = spark.createDataFrame([("m", 1, 0, 0.5), ("m", 1, 1, 0.25)], "aug string, seq int, seed int, logit double")
    writers.write_predictions(runs, f"{tmp_path}/r")
    writers.write_predictions(runs.where("seed = 1").withColumn("logit", F.lit(9.0)), f"{tmp_path}/r")
    assert {(r["seed"], r["logit"]) for r in spark.read.parquet(f"{tmp_path}/r").collect()} == {(0, 0.5), (1, 9.0)}


def test_checkpoints_need_a_shared_folder():
    from types import SimpleNamespace

    from textloom.plans.lineage import checkpoint_dir

    def session(master, known=None):
        sc = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda x: None)
        return SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, default: known))

    with pytest.raises(ValueError):
        checkpoint_dir(session("spark://host:7077"))
    with pytest.raises(ValueError):
        checkpoint_dir(session("local-cluster[3,2,1000]"))
    assert checkpoint_dir(session("yarn", "hdfs://x/y")) == "hdfs://x/y" and checkpoint_dir(session("local[4]"))
