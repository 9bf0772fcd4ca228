import json
import random

import pytest
from pyspark.sql import functions as F

from rankfuse.sources import json_array as J

SCHEMA = "id string, title string, references array<string>, more struct<a: string, b: array<struct<c: string>>>"


def records(n, seed):
    rnd = random.Random(seed)
    odd = ['}', '{', '"', '\\', '\\"', '}{', '[{"x": "}"}]', ',\n{', 'é日\U0001f600', '\n', '\t', '\\\\', '"}', ']', '\\u007d']
    text = lambda: "".join(rnd.choice([*odd, "word", " "]) for _ in range(rnd.randrange(12)))
    out = []
    for k in range(n):
        r = {"id": k if k % 3 else str(k), "title": text() * (200 if k % 17 == 5 else 1)}
        if k % 4:
            r["references"] = [text() for _ in range(rnd.randrange(5))]
        if k % 5 == 0:
            r["more"] = {"a": text(), "b": [{"c": text()} for _ in range(rnd.randrange(3))]}
        if k % 7 == 0:
            r["unknown"] = [[{"deep": [1, {"er": "}"}]}], None, 1.5e3, True]
        out.append(r)
    return out


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def schema(spark):
    return spark.createDataFrame([], SCHEMA).schema


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("split", [400, 1 << 20])
def test_equals_the_one_task_read(spark, schema, tmp_path, indent, split):
    for k in range(2):
        (tmp_path / f"part-{k}.json").write_text(json.dumps(records(30, k), indent=indent, ensure_ascii=k == 0))
    got = J.read_json_array(spark, str(tmp_path), schema, split)
    assert rows(got) == rows(spark.read.schema(schema).option("multiLine", True).json(str(tmp_path)))
    assert got.count() == 60


def test_ranges_are_read_apart_and_settings_stay(spark, schema, tmp_path):
    path = tmp_path / "corpus.json"
    path.write_text(json.dumps(records(200, 9), indent=1))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    objects = J.json_objects(spark, str(path), 4096)
    assert objects.rdd.getNumPartitions() >= path.stat().st_size // 4096
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    tasks = [r.n for r in objects.select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(tasks) > 10 and max(tasks) < 100
    # an object longer than many ranges, and frames that live in both sessions
    path.write_text(json.dumps([{"id": "1", "title": "}{" * 10000}, {"id": "2", "title": "x"}]))
    got = J.read_json_array(spark, str(path), schema, 1000)
    assert sorted((r.id, len(r.title)) for r in got.collect()) == [("1", 20000), ("2", 1)]
    both = got.join(spark.createDataFrame([("2", "in")], "id string, other string"), "id")
    assert [(r.id, r.other) for r in both.collect()] == [("2", "in")]


@pytest.mark.parametrize("text, ids", [
    ("", []), ("[]", []), (" \n[ ]\n", []), ("[{}]", [None]), ('[{"id":"a"}]', ["a"]), ('\n\n [\n{"id":"a"}\n,\n{"id":"b"}\n]\n', ["a", "b"]),
    ('{"id":"a"}\n{"id":"b", "more":{"a":"}"}}\n', ["a", "b"]), ('[1, "x{}", null, {"id":"a"}, "}", {"id":"b"}]', ["a", "b"]), ('{"id":"only"}', ["only"]),
])
@pytest.mark.parametrize("split", [3, 1000])
def test_odd_files(spark, schema, tmp_path, text, ids, split):
    (tmp_path / "a.json").write_text(text)
    got = J.read_json_array(spark, str(tmp_path / "a.json"), schema, split)
    assert sorted([r.id for r in got.collect()], key=str) == sorted(ids, key=str)


def test_written_arrays_read_back(spark, schema, tmp_path):
    (tmp_path / "in.json").write_text(json.dumps(records(50, 3)))
    df = spark.read.schema(schema).option("multiLine", True).json(str(tmp_path / "in.json"))
    J.write_json_array(df.repartition(3), str(tmp_path / "out"))
    assert rows(J.read_json_array(spark, str(tmp_path / "out"), schema, 500)) == rows(df)
    files = [f for f in (tmp_path / "out").glob("part-*") if f.stat().st_size]
    assert sum(len(json.loads(f.read_text())) for f in files) == 50


def test_the_corpus_reader_takes_arrays(spark, tmp_path):
    from rankfuse.sources import io

    (tmp_path / "c.json").write_text(json.dumps([{"id": 1, "title": "a } b", "references": ["2"]}, {"id": 2, "title": "c"}], indent=4))
    got = io.read_corpus_json(spark, str(tmp_path / "c.json"), multiline=True)
    assert sorted(map(tuple, got.collect())) == [("1", "a } b", ["2"]), ("2", "c", None)]


def test_the_registered_round_trip_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    from rankfuse.plans import catalog

    spark.range(40).selectExpr("id as doc_id", "concat('text ', id) as text").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(60).selectExpr("id as l_orderkey", "id % 7 as l_partkey").write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(catalog.io, "scratch", lambda _, name: str(tmp_path / name))
    monkeypatch.setitem(catalog.__dict__, "_WL", [])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = catalog.q_json_array_roundtrip(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, got)) == sorted((str(k), f"text {k}", str(k % 7)) for k in range(40))
    files = [f for f in (tmp_path / "corpus-array").glob("part-*") if f.read_text().strip()]
    assert len(files) > 1 and all(f.read_text().startswith("[") and f.read_text().strip().endswith("]") for f in files)
