"""Fingerprints of tables and publishing in two phases."""

import json
from dataclasses import asdict

import pytest
from pyspark.sql import functions as F

from corpusmetrics.operators import fingerprint as FP
from corpusmetrics.operators.checks import IntegrityError
from corpusmetrics.sources import publish as PB

SCHEMA = "k long, name string, vec array<double>, more map<string,int>, s struct<a:int,b:string>"


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, f"n{i}" if i % 5 else None, [float(i), None] if i % 3 else [], {"b": 1, "a": i}, (i, "x")) for i in range(200)]
    return spark.createDataFrame(data, SCHEMA)


def test_fingerprints_do_not_see_order_or_partitions(spark, rows):
    name = FP.fingerprint(rows)
    assert FP.fingerprint(rows.repartition(7)) == FP.fingerprint(rows.orderBy(F.desc("k")).select(*reversed(rows.columns))) == name
    turned = rows.withColumn("more", F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array(F.col("more")["a"], F.col("more")["b"])))
    assert FP.fingerprint(turned) == name


@pytest.mark.parametrize(
    "change",
    [
        lambda d: d.withColumn("name", F.when(F.col("k") == 7, "other").otherwise(F.col("name"))),
        lambda d: d.withColumn("name", F.when(F.col("k") == 5, "").otherwise(F.col("name"))),
        lambda d: d.withColumn("vec", F.when(F.col("k") == 4, F.array(F.lit(4.0))).otherwise(F.col("vec"))),
        lambda d: d.withColumn("s", F.when(F.col("k") != 3, F.col("s"))),
        lambda d: d.unionByName(d.where("k = 9")),
        lambda d: d.where("k != 9"),
        lambda d: d.unionByName(d),
        lambda d: d.withColumn("k", F.col("k").cast("int")),
        lambda d: d.withColumnRenamed("name", "title"),
    ],
)
def test_one_changed_cell_or_doubled_row_shows(rows, change):
    assert FP.fingerprint(change(rows)) != FP.fingerprint(rows)


def test_parts_add_up(rows):
    parts = FP.fingerprints(rows.withColumn("p", F.col("k") % 3), ["p"])
    whole = FP.fingerprints(rows).first()
    assert tuple(FP.merged(parts).first()) == tuple(whole)
    assert FP.fingerprints(rows.limit(0)).first()["rows"] == 0 and FP.fingerprint(rows.limit(0)) != FP.fingerprint(rows)


def test_a_dry_run_writes_nothing(rows, tmp_path):
    told = PB.publish(rows, f"file://{tmp_path}/t", ["k"], parts=4, dry_run=True)
    assert told.rows == 200 and len(told.parts) == 4 and sum(p["rows"] for p in told.parts) == 200
    assert not (tmp_path / "t").exists()


def test_an_aborted_write_is_invisible_and_a_resumed_one_gives_the_same_manifest(spark, rows, tmp_path):
    def stop(part):
        if part == 2:
            raise KeyboardInterrupt

    path = f"file://{tmp_path}/t"
    with pytest.raises(KeyboardInterrupt):
        PB.publish(rows, path, ["k"], parts=4, stop=stop)
    with pytest.raises(IntegrityError, match="nothing is published"):
        PB.published(spark, path)
    written = []
    manifest = PB.publish(rows.repartition(3), path, ["k"], parts=4, rows=200, stop=written.append)
    assert written == [2, 3]
    assert asdict(manifest) == asdict(PB.publish(rows, f"file://{tmp_path}/fresh", ["k"], parts=4)) == json.loads((tmp_path / "t" / PB.MANIFEST).read_text())
    assert FP.fingerprint(PB.published(spark, path)) == FP.fingerprint(rows) == manifest.fingerprint


def test_the_old_version_stays_until_the_new_one_is_whole(spark, rows, tmp_path):
    path = f"file://{tmp_path}/t"
    PB.publish(rows, path, ["k"], parts=2)

    def stop(part):
        raise OSError("full")

    with pytest.raises(OSError):
        PB.publish(rows.where("k < 50"), path, ["k"], parts=2, stop=stop)
    assert PB.published(spark, path).count() == 200
    PB.publish(rows.where("k < 50"), path, ["k"], parts=2)
    assert PB.published(spark, path).count() == 50


def test_wrong_counts_repeated_keys_and_damaged_parts_are_refused(spark, rows, tmp_path):
    path = f"file://{tmp_path}/t"
    with pytest.raises(IntegrityError, match="200 rows, not 201"):
        PB.publish(rows, path, ["k"], rows=201)
    with pytest.raises(IntegrityError, match="repeat a key"):
        PB.publish(rows.unionByName(rows.where("k = 1")), path, ["k"])
    told = PB.publish(rows, path, ["k"], parts=2, dry_run=True)
    job = told.parts[0]["path"].rsplit("/", 1)[0]
    rows.limit(3).withColumn("__part", F.lit(0)).write.partitionBy("__part").parquet(f"{path}/{job}")  # what a faulty writer may have left
    with pytest.raises(IntegrityError, match="does not hold"):
        PB.publish(rows, path, ["k"], parts=2)
    assert PB.publish(rows, path, ["k"], parts=2).rows == 200


def test_a_cached_result_holds_while_its_inputs_do(spark, rows, tmp_path):
    made = []

    def compute(source):
        made.append(1)
        return source.groupBy((F.col("k") % 4).alias("g")).count()

    path = f"file://{tmp_path}/c"
    ask = lambda source, **settings: sorted(tuple(r) for r in PB.cached(spark, path, {"rows": source}, settings, ["g"], lambda: compute(source), parts=2).collect())
    assert ask(rows) == ask(rows.repartition(5)) == [(g, 50) for g in range(4)] and len(made) == 1
    assert ask(rows.where("k != 3")) == [(0, 50), (1, 50), (2, 50), (3, 49)] and len(made) == 2
    ask(rows.where("k != 3"), seed=1)
    assert len(made) == 3


def test_an_empty_table_can_be_published(spark, rows, tmp_path):
    path = f"file://{tmp_path}/e"
    assert PB.publish(rows.limit(0), path, ["k"], rows=0).parts == []
    assert PB.published(spark, path).collect() == [] and PB.published(spark, path).columns == rows.columns
