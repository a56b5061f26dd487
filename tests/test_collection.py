"""The stored collection: rejected and failed loads change nothing, batches count once."""

import os

import pytest
from pyspark.sql import functions as F

from quillspark.operators import collection as K
from quillspark.streaming import incremental

SCHEMA = "chunk_id string, law string, text string, embedding array<float>, load_seq int"


def rows(spark, ids, value=1.0, law="l", seq=0):
    return spark.createDataFrame([(f"c{k}", law, f"text {k}", [value, float(k)], seq) for k in ids], SCHEMA)


@pytest.fixture
def table(spark, tmp_path):
    name = f"points_{os.path.basename(tmp_path).replace('-', '_')}"
    K.create(spark, name, 2, 8, location=str(tmp_path / "points"))
    yield name
    spark.sql(f"DROP TABLE {name}")


def files_of(tmp_path):
    root = tmp_path / "points"
    return {os.path.join(d, f)[len(str(root)) + 1 :] for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def held(spark, table):
    return sorted((r.chunk_id, r.law, r.batch, r.embedding[0]) for r in K.points(spark, table).collect())


def test_upsert_rewrites_touched_buckets_only(spark, table, tmp_path):
    K.upsert_into(spark, table, rows(spark, range(40)), 1)
    before = files_of(tmp_path)
    touched = K.upsert_into(spark, table, rows(spark, [3, 100], 2.0, "new").unionByName(rows(spark, [3], 5.0, "newest", 1)), 2)
    after = files_of(tmp_path)
    assert 1 <= len(touched) <= 2
    kept = {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert kept and kept <= after and not (before - kept) & after
    got = held(spark, table)
    assert len(got) == 41 and ("c3", "newest", 2, 5.0) in got and ("c100", "new", 2, 2.0) in got and ("c4", "l", 1, 1.0) in got
    # a batch that is run again doesn't undo a later one
    K.upsert_into(spark, table, rows(spark, range(40)), 1)
    assert held(spark, table) == got and K.last_batch(spark, table) == 2


def test_rejected_and_failed_loads_change_nothing(spark, table, tmp_path):
    K.upsert_into(spark, table, rows(spark, range(20)), 1)
    before, names = held(spark, table), files_of(tmp_path)
    for bad in ([1.0], [1.0, 2.0, 3.0], None):
        load = rows(spark, range(5)).withColumn("embedding", F.when(F.col("chunk_id") != "c3", F.col("embedding")).otherwise(F.lit(bad).cast("array<float>")))
        with pytest.raises(ValueError, match="c3"):
            K.upsert_into(spark, table, load, 2)

    @F.pandas_udf("array<float>")
    def dies(texts):
        raise RuntimeError("no model")

    with pytest.raises(Exception, match="no model"):
        K.add_new(spark, table, rows(spark, range(30)).drop("embedding"), dies, 2)
    assert held(spark, table) == before and files_of(tmp_path) == names


def test_dimension_of_an_existing_collection(spark, table):
    K.create(spark, table, 2, 8)
    with pytest.raises(ValueError, match="2 dimensions, not 3"):
        K.create(spark, table, 3)
    assert K.properties(spark, table) == (2, 8)


def test_only_the_buckets_of_the_ids_are_read(spark, table):
    K.upsert_into(spark, table, rows(spark, range(50)))
    ids = K.points(spark, table).where("chunk_id = 'c7'").select("id")
    few = K.points(spark, table, ids)
    assert "bucket" in few._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:80]
    assert 0 < few.count() < 50 and few.where("chunk_id = 'c7'").count() == 1


def test_a_batch_that_dies_after_its_write_counts_once(spark, table, tmp_path, monkeypatch):
    """The stream's first run is killed between the write and the end of the batch; the second runs the batch again."""

    @F.pandas_udf("array<float>")
    def embed(texts):
        return texts.map(lambda t: [float(len(t)), 1.0])

    load = rows(spark, range(30)).drop("embedding")
    load.write.parquet(str(tmp_path / "in"))
    schema, true_add, added = load.schema, K.add_new, []

    def stream():
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = incremental.collection_stream(source, table, str(tmp_path / "state"), embed).trigger(availableNow=True).start()
        query.awaitTermination()

    def dying(*args):
        added.append(true_add(*args))
        raise RuntimeError("killed")

    monkeypatch.setattr(K, "add_new", dying)
    with pytest.raises(Exception, match="killed"):
        stream()
    assert len(held(spark, table)) == 30

    def counted(*args):
        added.append(true_add(*args))

    monkeypatch.setattr(K, "add_new", counted)
    stream()
    assert added == [30, 0] and len(held(spark, table)) == 30
    rows(spark, range(20, 40)).drop("embedding").write.mode("append").parquet(str(tmp_path / "in"))
    stream()
    assert added[:3] == [30, 0, 10]
    got = held(spark, table)
    assert len(got) == 40 and {b for _, _, b, _ in got} == {0, 1} and K.last_batch(spark, table) == 1


def test_a_half_written_batch_is_completed(spark, table):
    """Some of a batch's files were moved in before it died: the rest is added, nothing twice."""

    @F.pandas_udf("array<float>")
    def embed(texts):
        return texts.map(lambda t: [1.0, 1.0])

    load = rows(spark, range(25)).drop("embedding")
    K.add_new(spark, table, load.where("chunk_id < 'c2'"), embed, 7)
    some = len(held(spark, table))
    assert 0 < some < 25
    assert K.add_new(spark, table, load.unionByName(load), embed, 7) == 25 - some
    assert len(held(spark, table)) == 25


def test_replacing_stream_and_empty_loads(spark, table, tmp_path):
    @F.pandas_udf("array<float>")
    def embed(texts):
        return texts.map(lambda t: [9.0, 1.0])

    K.upsert_into(spark, table, rows(spark, range(5)), 0)
    assert K.upsert_into(spark, table, rows(spark, [1]).limit(0), 1) == [] and K.add_new(spark, table, rows(spark, [1]).limit(0).drop("embedding"), embed, 1) == 0
    rows(spark, [2, 7]).drop("embedding").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows(spark, [1]).drop("embedding").schema).parquet(str(tmp_path / "in"))
    incremental.collection_stream(source, table, str(tmp_path / "state"), embed, replace=True).trigger(availableNow=True).start().awaitTermination()
    got = dict((c, v) for c, _, _, v in held(spark, table))
    assert got["c2"] == got["c7"] == 9.0 and got["c1"] == 1.0 and len(got) == 6
