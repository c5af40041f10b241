from plumbline.operators.measures import measure
from plumbline.operators.validate import QualityRules
from plumbline.streaming.batches import check_batches, flag_batches

SCHEMA = "event_id long, value double"


def feed(spark, folder, start, values):
    rows = [(start + i, v) for i, v in enumerate(values)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_checks_and_flags_per_batch(spark, tmp_path, rows):
    source, issues, flags = (str(tmp_path / n) for n in ("in", "issues", "flags"))
    history = spark.createDataFrame([(i, float(i % 5)) for i in range(100)], SCHEMA)
    _, _, moments = measure(history, ["value"])
    rules = QualityRules(numeric_ranges={"value": (0, 10)})
    for start, values in ((0, [1.0, 2.0, 50.0]), (3, [3.0, None, None])):
        feed(spark, source, start, values)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        check_batches(stream, issues, str(tmp_path / "c1"), rules).awaitTermination()
        flag_batches(stream, ["event_id"], moments, flags, str(tmp_path / "c2")).awaitTermination()
    found = rows(spark.read.parquet(issues), "batch")
    assert [(r["batch"], r["check_name"], r["affected_rows"]) for r in found] == [(0, "numeric_ranges", 1), (1, "nulls", 2)]
    assert [(r["batch"], r["event_id"], r["value"]) for r in rows(spark.read.parquet(flags))] == [(0, 2, 50.0)]
