"""Reductions of micro-batches."""

from siltwork.config import ReduceConfig
from siltwork.sources import logs
from siltwork.streaming.templates import reduce_batches


def test_each_batch_is_reduced(spark, tmp_path):
    logs.synthetic(spark, 400).coalesce(1).write.parquet(str(tmp_path / "in"))
    schema, seen = "log_id string, pos long, line string", []
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    writer = reduce_batches(stream, lambda r, n: seen.extend(r.output().collect()), ReduceConfig(budget=200))
    writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert [x.input_records for x in seen] == [400] and "ERROR failed to acquire" in seen[0].body
