import json

from pyspark.sql import functions as F

from quarry.operators import store
from quarry.sources import files
from quarry.streaming import events


def test_listing_prunes_and_excludes(spark, tmp_path):
    for p in ("a/x.py", "a/y.min.js", "node_modules/z.py", "b/c/w.md"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    got = files.listing(spark, str(tmp_path), ["*.min.js"])
    assert {r["path"].split("/")[-1] for r in got.collect()} == {"x.py", "w.md"}
    assert {r["ext"]: r["files"] for r in files.extensions(got).collect()} == {"py": 1, "md": 1}


def test_usage_log_skips_malformed(spark, tmp_path):
    good = json.dumps({"ts": "t", "actor": "a", "name": "n", "outcome": "hit", "score": 3})
    (tmp_path / "u.jsonl").write_text(good + "\n{broken\n" + good + "\n")
    assert files.usage_log(spark, str(tmp_path / "u.jsonl")).count() == 2


def test_markdown_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("d1", "guide", "T", "body\nmore")], "id string, content_type string, title string, content string")
    store.export_markdown(d, str(tmp_path / "out"))
    back = store.parse_front_matter(files.text_files(spark, str(tmp_path / "out"), "*.txt").select(F.regexp_replace("text", "\n$", "").alias("value")))
    assert tuple(back.first()) == ("d1", "T", "body\nmore")


def test_stream_equals_batch(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(src)
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    q = events.windowed(events.read_events(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = lambda d: sorted((str(r["start"]), r["event_type"], r["n"]) for r in d.collect())
    assert key(spark.table("w")) == key(events.windowed(batch.withColumn("ts", F.col("ts").cast("timestamp"))))


def test_stream_dedup(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch.union(batch).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = events.deduplicated(events.read_events(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("dd").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("dd").count() == batch.count()
