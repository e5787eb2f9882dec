from lodestone.streaming.incremental import index_stream, latest_postings


def test_batches_are_indexed_and_replaced(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame([(1, "red apple red"), (2, "pear")], "id long, name string").coalesce(1).write.parquet(f"{source}/a")
    stream = lambda: index_stream(spark.readStream.schema("id long, name string").parquet(f"{source}/*"), "id", ["name"], out, f"{tmp_path}/cp").awaitTermination()
    stream()
    spark.createDataFrame([(1, "green apple")], "id long, name string").coalesce(1).write.parquet(f"{source}/b")
    stream()
    rows = latest_postings(spark.read.parquet(out)).select("pk", "term", "tf").collect()
    assert sorted(map(tuple, rows)) == [(1, "apple", 1), (1, "green", 1), (2, "pear", 1)]
