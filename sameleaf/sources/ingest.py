"""Sources of documents: files by content hash, parsed JSON, and any extractor for what needs a decoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as T

HASHES: dict[str, Callable[[Column], Column]] = {"SHA256": lambda c: F.sha2(c, 256), "SHA1": F.sha1, "MD5": F.md5}


def content_hash(c: Column, algorithm: str = "SHA256") -> Column:
    if algorithm.upper() not in HASHES:
        raise ValueError(f"unknown algorithm: {algorithm}")
    return HASHES[algorithm.upper()](c)


def files(spark: SparkSession, *paths: str, algorithm: str = "SHA256", glob: str | None = None) -> DataFrame:
    """file_hash, file_name, file_path, size, modified, content of each file, folders searched to any depth."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    found = reader.load(list(paths))
    return found.select(content_hash(F.col("content"), algorithm).alias("file_hash"), T.basename(F.col("path")).alias("file_name"), F.col("path").alias("file_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def listing(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """Name, path, size and time of the files below a folder; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return found.select(T.basename(F.col("path")).alias("name"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def extract(found: DataFrame, extractor: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """Glyph runs, images or metadata by a decoder of the caller's: a function over pandas batches of files()."""
    return found.mapInPandas(extractor, schema)


def parsed(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """documents, sentences and images from parsed JSON files."""
    raw = spark.read.schema(schemas.PARSED).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    documents = raw.select(F.col("fileHash").alias("file_hash"), F.col("fileName").alias("file_name"), F.col("filePath").alias("file_path"), F.col("metadata.info").alias("metadata"))
    texts = raw.select(F.col("fileHash").alias("file_hash"), F.posexplode("texts").alias("ord", "t"))
    images = raw.select(F.col("fileHash").alias("file_hash"), F.posexplode("images").alias("ord", "i"))
    return {
        "documents": documents,
        "sentences": texts.select("file_hash", F.col("t.pageNumber").alias("page"), "ord", F.col("t.text").alias("text"), F.coalesce("t.vector", T.vector(F.col("t.text"))).alias("vector")),
        "images": images.select("file_hash", F.col("i.pageNumber").alias("page"), "ord", F.col("i.name").alias("name"), F.col("i.image").alias("image"), F.col("i.imageHash").alias("image_hash"), F.col("i.width").alias("width"), F.col("i.height").alias("height")),
    }
