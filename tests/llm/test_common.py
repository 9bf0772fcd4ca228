import glob
import os
import subprocess
import sys

import pytest

from rankfuse.llm import common


def test_stage_unstage_release(spark):
    a = common.stage(spark.range(5), "a")
    b = common.stage(spark.range(0), "b")
    assert a.count() == 5 and b.count() == 0
    root = common.scratch_root(spark).removeprefix("file:")
    common.unstage(a)
    assert not os.path.exists(a.staged_at.removeprefix("file:")) and glob.glob(f"{root}/b-*")
    common.unstage(b)


def test_prefix_sums_against_a_plain_window(spark):
    rows = [(k % 3, k // 7, k, k * k % 11) for k in range(100)]
    df = spark.createDataFrame(rows, "g int, b int, o int, v long")
    got = {r.o: r.s for r in common.prefix_sums(df, ["g"], ["b"], ["o"], "v", "s").collect()}
    assert got == {o: sum(v for g2, _, o2, v in rows if g2 == g and o2 < o) for g, _, o, _ in rows}


def test_located_rows_are_the_same_in_every_scan(spark, docs):
    def places(df):
        return sorted((r.place.file, r.place.at, str(r.text)) for r in common.located(df, "place").select("place", "text").collect())

    first = places(docs)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        assert places(docs) == first
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({p[:2] for p in first}) == len(first) == docs.count()
    made = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert len({p[:2] for p in places(made)}) == 2


def test_names(spark):
    df = spark.createDataFrame([(1, 2)], "Row int, _row int")
    assert common.fresh(df, "row", "row") == ["__row", "___row"]


def test_workers_need_not_have_the_package(tmp_path):
    """A session started elsewhere, with the package on the driver's path only."""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys; sys.path.insert(0, {repo!r})
from rankfuse.session import local_session
spark = local_session(1, 1)
from rankfuse.llm import simhash
df = spark.createDataFrame([(1, 'a b c d e'), (2, 'a b c d e')], 'doc_id long, text string')
print([tuple(r) for r in simhash.digests(df).collect()])
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.count(", 1)") == 2, done.stderr[-2000:]


def test_a_cluster_without_a_shared_folder_is_an_error(spark, monkeypatch):
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})()

        class sparkContext:  # noqa: N801
            master = "spark://x"
            _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

    with pytest.raises(ValueError):
        common.shared_dir(Session())
