"""Reviews over a stream of pairs: stateless, batch by batch, each pair on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..options import Options
from ..plans.review import review


def read_stream(spark: SparkSession, path: str, schema: str = "pair_id string, old_name string, old_src string, new_name string, new_src string", files_per_batch: int = 100) -> DataFrame:
    """A stream of parquet files of pairs."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def write_reviews(stream: DataFrame, path: str, checkpoint: str, options: Options = Options()) -> StreamingQuery:
    """Append the reviews of every batch as parquet; exactly once by the sink's own log."""
    return review(stream, options).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
