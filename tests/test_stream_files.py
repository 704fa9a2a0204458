"""A table becomes a stream of a fixed number of batches whose files are as many as its scan has splits."""

from pyspark.sql import functions as F

from tidemark.plans import stream_queries
from tidemark.session import scratch


def test_files_of_a_batch_follow_the_scan(spark):
    root = scratch(spark, "wide")
    spark.range(0, 700, 1, 7).write.parquet(f"{root}/wide.parquet")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        source = stream_queries.table(spark, root, "wide").rdd.getNumPartitions()
        stream = stream_queries._table_stream(spark, root, "wide", 3)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    batches = []
    query = stream.writeStream.foreachBatch(lambda df, n: batches.append((df.select(F.input_file_name()).distinct().count(), df.count()))).option("checkpointLocation", scratch(spark, "wide-state"))
    query.trigger(availableNow=True).start().awaitTermination()
    assert source >= 7 and len(batches) == 3 and sum(n for _, n in batches) == 700 and all(n > 1 for n, _ in batches)
