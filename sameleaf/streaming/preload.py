"""Documents taken into the store as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.segment import line_sentences, with_vectors
from ..sources.ingest import content_hash
from ..sources.store import Store

def preload(spark: SparkSession, store: Store, path: str, checkpoint: str, glob: str = "*.txt", on_batch: Callable[[int, int], None] | None = None, once: bool = True) -> StreamingQuery:
    """Text files of a folder, each content once: hashed, cut to sentences with vectors, written to the store.

    Each micro-batch leaves out what was taken in before; on_batch(batch, rows) tells what it added.
    """
    schema = spark.read.format("binaryFile").load(path).schema
    arriving = spark.readStream.schema(schema).format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    arriving = arriving.select(content_hash(F.col("content")).alias("file_hash"), F.decode("content", "UTF-8").alias("text"))

    def write(batch: DataFrame, number: int) -> None:
        known = store.read("taken", "file_hash string").select("file_hash")
        new = batch.dropDuplicates(["file_hash"]).join(known, "file_hash", "left_anti").persist()
        made = with_vectors(line_sentences(new, "file_hash")).persist()
        made.write.mode("append").parquet(f"{store.path}/sentences")
        new.select("file_hash").write.mode("append").parquet(f"{store.path}/taken")  # also of files without a sentence
        if on_batch:
            on_batch(number, made.count())
        made.unpersist()
        new.unpersist()

    writer = arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()
