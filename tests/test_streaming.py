import datetime as dt

from pyspark.sql import functions as F

from riskloom.operators.trailing import velocity_measures, with_trailing
from riskloom.streaming import windows
from riskloom.streaming.history import velocity_with_history
from riskloom.streaming.micro_batch import against_history, run_batches, score_stream, write_once

SCHEMA = "transaction_id string, user_id bigint, ts timestamp_ntz, amount double"
T0 = dt.datetime(2024, 1, 1)


def rows(spark, n=40):
    data = [(f"t{i:03d}", i % 3, T0 + dt.timedelta(hours=7 * i), float(i)) for i in range(n)]
    return spark.createDataFrame(data, SCHEMA)


def test_velocity_over_several_batches(spark, tmp_path):
    """Four files, one per micro-batch; each batch, and each retry of it, sees the rows of those before it."""
    table = rows(spark)
    source, out, store = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "store")
    for part in range(4):
        chunk = table.filter((F.substring("transaction_id", 2, 3).cast("int") / 10).cast("int") == part)
        chunk.coalesce(1).write.mode("append").parquet(source)
    once = against_history(velocity_with_history, out, store)

    def twice(batch, batch_id):
        once(batch, batch_id)
        once(batch, batch_id)

    from pyspark.sql.types import _parse_datatype_string

    stream = windows.stream_source(spark, source, _parse_datatype_string(SCHEMA), files_per_trigger=1)
    run_batches(stream, twice, str(tmp_path / "state"), available_now=True).awaitTermination()
    got = spark.read.parquet(out)
    assert got.select("batch_id").distinct().count() == 4
    want = with_trailing(table, velocity_measures([1, 7, 30], F.col("amount")))
    assert want.exceptAll(got.select(*want.columns)).count() == 0 and got.count() == 40
    assert spark.read.parquet(store).count() == 40


def test_retried_batch_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "scored")
    write_once(rows(spark, 5), path, 0)
    write_once(rows(spark, 7), path, 1)
    write_once(rows(spark, 6), path, 1)
    assert spark.read.parquet(path).count() == 11


def test_score_stream_is_restartable(spark, tmp_path):
    from pyspark.sql.types import _parse_datatype_string

    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows(spark, 8).write.parquet(source)
    stream = lambda: windows.stream_source(spark, source, _parse_datatype_string(SCHEMA))
    score = lambda b: b.withColumn("doubled", F.col("amount") * 2)
    score_stream(stream(), score, out, state, available_now=True).awaitTermination()
    score_stream(stream(), score, out, state, available_now=True).awaitTermination()
    assert spark.read.parquet(out).count() == 8
