from pyspark.sql import functions as F

from tessella.operators import observed


def test_log_and_metrics(spark, tmp_path):
    log = observed.StageLog(spark, str(tmp_path / "log"), "j")
    df = spark.range(10).withColumnRenamed("id", "doc_id")
    log.emit_documents(df, "build_doc_started")
    assert observed.written(df, str(tmp_path / "t"), log, most=F.max("doc_id")) == {"rows": 10, "most": 9}
    rows = log.read().collect()
    assert len(rows) == 12 and {(r.name, r.value) for r in rows if r.doc is None} == {("rows", 10), ("most", 9)}
    assert {r.doc for r in rows if r.doc} == {str(i) for i in range(10)}
    assert observed.written(df.limit(0), str(tmp_path / "u"), None, most=F.max("doc_id")) == {"rows": 0, "most": 0}
    bad = observed.StageLog(spark, "nowhere://x", "j")
    bad.emit("job_started")
    assert bad.lost == 1


def test_listener(spark, tmp_path):
    listener = observed.ProgressListener()
    spark.streams.addListener(listener)
    try:
        spark.range(7).write.parquet(str(tmp_path / "in"))
        q = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
        q.awaitTermination()
        for _ in range(100):
            if any(stage == "job_completed" for _, stage, _ in listener.events):
                break
            import time

            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert [stage for _, stage, _ in listener.events][0] == "job_started" and listener.rows[str(q.runId)] == 7
