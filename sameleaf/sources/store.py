"""The store: parsed documents by content hash, and results by group. Parquet inside, JSON for exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def new_only(found: DataFrame, stored: DataFrame | None, key: str = "file_hash") -> DataFrame:
    """Rows whose key isn't stored yet, one for each key."""
    found = found.dropDuplicates([key])
    return found if stored is None else found.join(stored.select(key), key, "left_anti")


class Store:
    def __init__(self, spark: SparkSession, path: str):
        if not path:
            raise ValueError("a store needs a path")
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def read(self, name: str, schema: str) -> DataFrame:
        """A table of the store; empty where nothing was written yet."""
        if not self._exists(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def add_parsed(self, name: str, rows: DataFrame, schema: str) -> None:
        """Write once: rows of documents that are stored already are left out."""
        stored = self.read(name, schema).select("file_hash").distinct()
        rows.join(stored, "file_hash", "left_anti").write.mode("append").parquet(f"{self.path}/{name}")

    def by_hash(self, name: str, schema: str, file_hash: str) -> DataFrame:
        return self.read(name, schema).where(F.col("file_hash") == file_hash)

    def keep_originals(self, found: DataFrame) -> None:
        """The files themselves (file_hash, file_name, content), each content once."""
        self.add_parsed("originals", new_only(found.select("file_hash", "file_name", "content"), None), "file_hash string, file_name string, content binary")

    def append_results(self, results: DataFrame) -> None:
        results.write.mode("append").partitionBy("groupid").parquet(f"{self.path}/results")

    def results(self, group: str | None = None) -> DataFrame:
        out = self.read("results", schemas.RESULTS)
        return out if group is None else out.where(F.col("groupid") == group)

    def result(self, group: str) -> DataFrame | None:
        """A group's results; None for a group that isn't there."""
        found = self.results(group)
        return None if found.isEmpty() else found

    def export_json(self, results: DataFrame, name: str) -> None:
        results.write.mode("overwrite").json(f"{self.path}/result/{name}")

    def import_json(self, name: str | None = None) -> DataFrame:
        """Results from JSON files, of one object (also pretty-printed) or of one a line; broken ones are left out. Nothing there gives no rows."""
        if not self._exists(f"result/{name}" if name else "result"):
            return self.spark.createDataFrame([], schemas.RESULTS)
        reader = self.spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
        whole = reader.text(f"{self.path}/result/{name}" if name else f"{self.path}/result")
        lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
        each = F.forall("lines", lambda x: F.trim(x).startswith("{") & F.trim(x).endswith("}"))
        found = whole.select("value", lines.alias("lines")).select(F.explode(F.when(each, F.col("lines")).otherwise(F.array("value"))).alias("value"))
        return found.select(F.from_json("value", schemas.RESULTS).alias("r")).select("r.*").where(F.col("uuid").isNotNull())


def group_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """key, items (in order) of each group; rows without a key stay alone."""
    item = F.struct(*[F.col(c) for c in df.columns])
    grouped = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), item.alias("item")))).alias("__i"))
    grouped = grouped.select(key, F.transform("__i", lambda x: x["item"]).alias("items"), F.lit(True).alias("grouped"))
    alone = df.where(F.col(key).isNull()).select(key, F.array(item).alias("items"), F.lit(False).alias("grouped"))
    return grouped.unionByName(alone)
