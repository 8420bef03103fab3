from weftlink.operators import block
from weftlink.plans import tasks
from weftlink.streaming.match import match_stream, reference_index


def test_stream_equals_batch(spark, sf, tmp_path):
    task = tasks.Task(spark, sf)
    refs, queries = task.refs, task.queries
    fields = queries.select("id", "country", "nm", "nm_cmp", "ad")
    fields.repartition(3).write.parquet(f"{tmp_path}/in")
    index = reference_index(refs)
    index.write.parquet(f"{tmp_path}/index")
    stream = spark.readStream.schema(fields.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    match_stream(stream, spark.read.parquet(f"{tmp_path}/index"), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination(120)
    side = lambda df: sorted((r["qid"], r["s1"], round(r["score"], 6), r["nk"], r["rank"]) for r in df.collect())
    assert side(spark.read.parquet(f"{tmp_path}/out")) == side(block.candidates(refs, queries))
