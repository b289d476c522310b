"""A batch is worked out once, however often its result reads it. F6."""

from ordwell.streaming import batches
from pyspark.sql import functions as F


def test_result_that_reads_twice(spark, tmp_path):
    spark.range(50).coalesce(1).write.parquet(f"{tmp_path}/in")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in").select(counted("id").alias("id"))
    twice = lambda rows, _: rows.where("id % 2 = 0").unionByName(rows.where("id % 2 = 1"))
    batches.run(batches.each_batch(stream, f"{tmp_path}/out", twice), spark)
    assert batches.written(spark, f"{tmp_path}/out", stream.schema).count() == 50
    assert seen.value == 50
