"""The streaming join finds the pairs that the batch join finds."""

from tandem.operators.cooccur import band_pairs, sides
from tandem.streaming.live import live_pairs, live_weights


def test_live_pairs(spark, tmp_path):
    data = [(f"m{i}", f"u{i % 4}", i * 7 % 50, ["a", "b", None][i % 3]) for i in range(40)]
    rows = spark.createDataFrame(data, "message_id string, user_id string, s int, k string").selectExpr("*", "timestamp_seconds(s + 1700000000) as at", "cast(s as double) as timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = live_pairs(stream, "k", 10).writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    left, right = sides(rows.where("k is not null"), ["k"])
    want = band_pairs(left, right, 10, ["k"])
    pairs = lambda df: {(r["m1"], r["m2"]) for r in df.collect()}
    assert pairs(spark.table("live")) == pairs(want)
    assert live_weights(spark.table("live")).count() > 0
