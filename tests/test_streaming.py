from quillspark.streaming import jobs


def test_batches_go_on_where_they_ended(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))

    def add(k):
        spark.createDataFrame([(k, f"page {k}")], "page_no int, text string").coalesce(1).write.mode("append").parquet(src)

    def run():
        jobs.batches(spark, src, "page_no int, text string", lambda d: d.selectExpr("page_no", "upper(text) as text"), out, check, 2).awaitTermination()
        return sorted(r.page_no for r in spark.read.parquet(out).collect())

    for k in range(3):
        add(k)
    assert run() == [0, 1, 2]
    assert run() == [0, 1, 2]
    add(3)
    assert run() == [0, 1, 2, 3]


def test_segment_log(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text('{"s": 0, "e": 1.5, "t": "x"}\n{"s": 1.5, "e": 4.0, "t": "y"}\n{"s": 4.0, "e"\n')
    q = jobs.resume_points(jobs.segment_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("resume").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.resume_at, r.n) for r in spark.sql("select * from resume").collect()] == [(4.0, 2)]


def test_rolling_captions(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("v", 1, "hello everyone"), ("v", 2, "everyone and welcome"), ("v", 3, "and welcome"), ("v", 4, "new cue"), ("w", 1, "new cue")], "video string, cue_no long, text string").write.parquet(src)
    stream = spark.readStream.schema("video string, cue_no long, text string").parquet(src)
    q = jobs.rolling_captions(stream).writeStream.outputMode("append").format("memory").queryName("rolled").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.video, r.cue_no, r.text) for r in spark.sql("select * from rolled").collect())
    assert got == [("v", 1, "hello everyone"), ("v", 2, "and welcome"), ("v", 4, "new cue"), ("w", 1, "new cue")]


def test_index_refresh_and_events(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", "x y")], "path string, text string").write.parquet(src)
    q = jobs.refresh_index(spark.readStream.schema("path string, text string").parquet(src), lambda d: d.selectExpr("path", "explode(split(text, ' ')) as term"), str(tmp_path / "out"), str(tmp_path / "c"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert jobs.event_counts(events).agg({"n": "sum"}).first()[0] == events.count()
