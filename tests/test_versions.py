"""Rebuilds behind a gate, and upserts that leave other buckets alone."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from paysift.operators import quality as Q
from paysift.operators.cases import upsert
from paysift.sources import ingest as S
from paysift.sources import versions as V

SUITE = (Q.Expect("row_count", args={"least": 1}), Q.Expect("columns", args={"names": ["id", "v"]}), Q.Expect("unique", "id"), Q.Expect("not_null", "v"), Q.Expect("between", "v", {"low": 0}))


@pytest.fixture
def table(spark):
    return lambda *rows: spark.createDataFrame(list(rows), "id long, v double")


def ids(rows):
    return sorted(r.id for r in rows.collect())


def test_a_refused_rebuild_leaves_the_table(spark, table, tmp_path):
    path = str(tmp_path / "t")
    assert V.publish(table((1, 1.0), (2, 2.0)), path, SUITE)["number"] == 1
    bad = {"unique": table((3, 1.0), (3, 2.0)), "not_null": table((4, None)), "between": table((5, -1.0)), "row_count": table(), "columns": table((6, 1.0)).withColumn("w", F.lit(1))}
    for name, rows in bad.items():
        with pytest.raises(ValueError, match=f"does not meet.*{name}"):
            V.publish(rows, path, SUITE)
        assert ids(V.read_version(spark, path)) == [1, 2]
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v-")]) == 1
    assert V.publish(bad["between"], path, SUITE, skip=True)["failures"] == ["between(v)"] and ids(V.read_version(spark, path)) == [5]


def test_the_gate_gives_what_check_gives(spark, table, tmp_path):
    rows = table((1, 1.0), (1, None), (2, -3.0))
    want = Q.suite_result(Q.check(rows, SUITE)).first()
    assert V.publish(rows, str(tmp_path / "t"), SUITE, skip=True)["failures"] == want.failures == ["between(v)", "not_null(v)", "unique(id)"]


def test_rows_are_read_once(spark, table, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    rows = spark.range(1000).select("id", F.lit(1.0).alias("v")).mapInPandas(count, "id long, v double")
    assert V.publish(rows, str(tmp_path / "t"), SUITE)["rows"] == 1000 and seen.value == 1000


def test_a_table_is_rebuilt_from_itself_with_other_columns(spark, table, tmp_path):
    path = str(tmp_path / "t")
    S.append_batch(table((1, 1.0), (2, 2.0)).withColumn("day", F.lit("d")), path, "day")
    assert ids(S.read_layer(spark, path)) == [1, 2]
    for n in (3, 4):
        S.rebuild(S.read_layer(spark, path).withColumn(f"c{n}", F.lit(n)).drop("v"), path, "day")
    last = S.read_layer(spark, path)
    assert last.columns == ["id", "day", "c3", "c4"] or set(last.columns) == {"id", "day", "c3", "c4"}
    assert ids(last) == [1, 2] and V.read_version(spark, path, 1).where("c3 = 3").count() == 2
    assert V.drop_old_versions(spark, path, keep=1) == [1] and ids(S.read_layer(spark, path)) == [1, 2]
    with pytest.raises(FileNotFoundError):
        V.read_version(spark, path, 1)


def test_a_write_that_dies_changes_nothing(spark, table, tmp_path):
    path = str(tmp_path / "t")
    V.publish(table((1, 1.0)), path)

    def die(frames):
        for frame in frames:
            yield frame
        raise OSError("lost")

    with pytest.raises(Exception, match="lost"):
        V.publish(table((2, 2.0)).mapInPandas(die, "id long, v double"), path, SUITE)
    assert ids(V.read_version(spark, path)) == [1]
    V.drop_old_versions(spark, path)
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v-")]) == 1


def test_of_two_runs_one_is_refused(spark, table, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    monkeypatch.setattr(V, "versions", lambda *_: [])  # neither saw the other
    V.publish(table((1, 1.0)), path)
    with pytest.raises(FileExistsError):
        V.publish(table((2, 2.0)), path)
    monkeypatch.undo()
    assert ids(V.read_version(spark, path)) == [1]


CASES = "transaction_id long, amount double, decision string, resolution string"


def test_an_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "c")
    stored = spark.range(500).select(F.col("id").alias("transaction_id"), F.lit(1.0).alias("amount"), F.lit("allow").alias("decision"), F.lit("old").alias("resolution"))
    V.create_buckets(stored, path, buckets=32)
    files = lambda: {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}
    before = files()
    new = spark.createDataFrame([(3, 9.0, "block", "new"), (40, 9.0, "block", "new"), (900, 9.0, "review", "new")], CASES)
    touched = V.upsert_buckets(new, path)
    assert 0 < len(touched) <= 3
    of = lambda p: int(p.parent.name.partition("=")[2])
    after = files()
    assert {p: t for p, t in before.items() if of(p) not in touched} == {p: t for p, t in after.items() if of(p) not in touched}
    assert not {p for p in before if of(p) in touched} & after.keys()
    plain = lambda rows: sorted(map(tuple, rows.select("transaction_id", "amount", "decision", "resolution").collect()))
    want = plain(upsert(stored, new))
    assert plain(V.read_buckets(spark, path)) == want and len(want) == 501
    assert V.upsert_buckets(new, path) == touched and plain(V.read_buckets(spark, path)) == want
    assert V.upsert_buckets(new.limit(0), path) == [] and plain(V.read_buckets(spark, path)) == want


def test_new_rows_that_share_a_key_are_one(spark, tmp_path):
    path = str(tmp_path / "c")
    V.create_buckets(spark.createDataFrame([(1, 1.0, "allow", "old")], CASES), path, buckets=4)
    V.upsert_buckets(spark.createDataFrame([(2, 5.0, "allow", "new"), (2, 6.0, "block", "new")], CASES), path)
    assert sorted(map(tuple, V.read_buckets(spark, path).drop("bucket").collect())) == [(1, 1.0, "allow", "old"), (2, 6.0, "block", "new")]
