"""Document deduplication of a stream: the first row of each text to arrive stays.

The batch operators keep the first by priority; a stream can only keep the first to arrive, so the two may differ in which copy stays, never in
which texts do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.profiles import CORPUS_WORDS, Quality
from millrace.operators.gates import quality_reason


def deduplicated(stream: DataFrame, text: str = "text", quality: Quality | None = Quality()) -> DataFrame:
    """Cleaned rows that pass the quality gate, each text once. State is one digest for each distinct text."""
    rows = stream.withColumn(text, T.clean(F.col(text)))
    if quality:
        # A filter on the reason must stay above it; pushed below, it would repeat the cleaning for each rule. What depends on the partition stays.
        rows = rows.withColumn("_words", T.lexed(F.col(text), CORPUS_WORDS)).withColumns({"_reason": quality_reason(F.col(text), F.col("_words"), quality), "_part": F.spark_partition_id()})
        rows = rows.where("_reason IS NULL AND _part >= 0").drop("_words", "_reason", "_part")
    return rows.withColumn("digest", F.md5(text)).dropDuplicates(["digest"])


def run_once(spark: SparkSession, path: str, schema, out: str, checkpoint: str) -> None:
    """Read all files of a folder (or one, by a pattern) as a stream, deduplicate, and append to Parquet; a restart goes on where the checkpoint stands."""
    stream = spark.readStream.schema(schema).parquet(path)
    deduplicated(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
