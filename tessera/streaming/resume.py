"""Resumable extraction as a stream over a growing table of chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.extract import extract_with_model, prompted, to_extract
from tessera.session import cut_lineage
from tessera.sources.tables import read_or_empty

RESULTS = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("prompt_hash", T.StringType()),
        T.StructField("result", T.StringType()),
        T.StructField("attempts", T.IntegerType()),
    ]
)


def extract_new(spark: SparkSession, chunks: str, results: str, checkpoint: str, ask: Callable[[str, int], tuple[str, bool]], prompt: str, schema: T.StructType) -> None:
    """Extracts from every chunk file that has come since the last run, then stops (STM1, UDF4, SNK7).

    ``ask`` gets the prompt with its places filled and a token budget. Results are appended under the batch's number, so a batch that is run again overwrites its own; chunks that have a result for this
    prompt are not asked again. Failures are not recorded and so are retried when the chunk comes again; another prompt starts afresh
    (STM3).
    """
    digest = spark.range(1).select(F.sha2(F.lit(prompt), 256)).first()[0]

    def run(batch: DataFrame, number: int) -> None:
        done = read_or_empty(spark, f"{results}/*", RESULTS).where(F.col("prompt_hash") == digest)
        asked = cut_lineage(extract_with_model(to_extract(batch.dropDuplicates(["chunk_id"]), done), prompted(ask, prompt)))
        failed = asked.where("error IS NOT NULL").select("chunk_id").distinct()  # a chunk is done when all its parts are
        rows = asked.join(failed, "chunk_id", "left_anti").select("chunk_id", "part", F.lit(digest).alias("prompt_hash"), F.to_json("result").alias("result"), "attempts")
        rows.write.mode("overwrite").parquet(f"{results}/batch={number:09d}")

    stream = spark.readStream.schema(schema).parquet(chunks)
    stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
