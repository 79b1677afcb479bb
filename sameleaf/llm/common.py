"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import os
import tempfile
from collections.abc import Callable, Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def importable(spark: SparkSession) -> None:
    """Python workers started from now on look for this package where the driver has it, too."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if root not in paths and root not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; other letters stay as they are."""
    return F.translate(c, UPPER, UPPER.lower())


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Unset, it is one of this machine's own, but only where all runs on this machine, as in tests."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir()
    if not at:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at:
            if not (sc.master or "").startswith("local[") and sc.master != "local":
                raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
            at = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(at)
    return at


def remove(spark: SparkSession, folder: str) -> None:
    """Takes a written table away."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, so lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_in_loop(df: DataFrame) -> DataFrame:
    """The same without Catalyst's estimates: of a join they are products, which loops square from turn to turn."""
    done, spark = cut(df)._jdf, df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(done.toJavaRDD(), done.schema()), spark)


def keep_columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: further columns can't clash with those that an operator adds."""
    return docs.select(*[F.col(f"`{n}`") for n in names])


#: Drops what an operator keeps in a worker process from task to task, by operator.
KEPT: dict[str, Callable[[], None]] = {}


def drop_others(keep: str | None) -> None:
    for name, drop in KEPT.items():
        if name != keep:
            drop()


@cache
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def give_back() -> None:
    """Memory that Arrow's pool and malloc hold free goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f for a worker process, which outlives it: other operators' caches go first, and memory that f freed isn't held when it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_others(keep)
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def single_threaded() -> None:
    for k in ("TOKENIZERS_PARALLELISM", "RAYON_NUM_THREADS"):
        os.environ[k] = "false" if k.startswith("TOK") else "1"
