"""Parts of a table as micro-batches, each of as many files as it takes."""

from pyspark.sql import functions as F

from rubrika.plans.catalog import _stream


def test_a_part_is_one_micro_batch_of_many_files(spark, tmp_path):
    rows = spark.range(0, 40, 1, 4).select("id", F.concat(F.lit("t"), "id").alias("text"))
    rows = rows.withColumn("text", F.when(F.col("id") != 7, F.col("text")))
    session = spark.newSession()
    rows.write.parquet(str(tmp_path / "rows"))
    session.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    session.conf.set("spark.sql.files.openCostInBytes", "1k")
    table = session.read.parquet(str(tmp_path / "rows"))
    tasks = table.rdd.getNumPartitions()
    assert tasks > 1
    conditions = ["id < 3", "id >= 3 AND id % 2 = 0", "id > 100", "id >= 3 AND id % 2 = 1"]
    batches = {}

    def keep(batch, epoch):
        files = batch.select(F.input_file_name()).distinct().count()
        batches[epoch] = sorted(map(tuple, batch.collect())), files

    parts = [table.where(c) for c in conditions]
    query = _stream(session, parts, "parts").writeStream.foreachBatch(keep)
    query = query.option("checkpointLocation", str(tmp_path / "offsets")).trigger(availableNow=True)
    query.start().awaitTermination()
    assert [batches[k][0] for k in sorted(batches)] == [sorted(map(tuple, p.collect())) for p in parts]
    assert batches[1][1] > 1 and batches[3][1] > 1  # no task writes or reads a whole part
