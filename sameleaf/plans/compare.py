"""The comparison of documents: all pairs at once, as one plan."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import joins as J
from ..operators.segment import at_least, line_sentences, with_vectors
from ..settings import Settings
from ..sources.store import Store
from .progress import Handler, Progress, duration_text, logger

#: Places of a perceptual hash.
BITS = 100


class DocumentComparator:
    """Compares documents given as tables: documents (file_hash, file_name, metadata), sentences and images.

    Nothing is kept between calls: each compare() pairs the documents it is given.
    """

    def __init__(self, spark: SparkSession, settings: Settings | None = None, store: Store | None = None, bits: int = BITS):
        self.spark, self.settings, self.store, self.bits = spark, settings or Settings(), store, bits

    def pairs(self, documents: DataFrame) -> DataFrame:
        """Pairs in the order of ord; the same file twice is a pair, too."""
        return J.document_pairs(documents)

    def _sides(self, rows: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        side = lambda key: rows.join(pairs.select("pair_id", F.col(key).alias("file_hash")), "file_hash").drop("file_hash")
        return side("hash_l"), side("hash_r")

    def compare_texts(self, pairs: DataFrame, sentences: DataFrame, tender: DataFrame | None = None) -> DataFrame:
        """Similar sentences of each pair. tender: sentences to leave out on both sides."""
        s = self.settings.text
        some = at_least(sentences, s.min_length)
        some = J.exclude(some, tender, s.threshold, drop_without_candidates=s.drop_without_candidates, drop_vectors=s.drop_vectors, on=["file_hash"])
        # Different texts are compared once over all documents; where they occur meets the pairs after that.
        some = some.join(pairs.select(F.explode(F.array("hash_l", "hash_r")).alias("file_hash")).distinct(), "file_hash", "left_semi")
        found = J.text_join(some, some, s.threshold, carry=("file_hash",))
        of = pairs.select("pair_id", F.col("hash_l").alias("a_file_hash"), F.col("hash_r").alias("b_file_hash"))
        return found.join(of, ["a_file_hash", "b_file_hash"]).drop("a_file_hash", "b_file_hash")

    def compare_images(self, pairs: DataFrame, images: DataFrame) -> DataFrame:
        s = self.settings.image
        some = images.select("file_hash", "page", "ord", "image", "image_hash", "width", "height")
        return J.image_join(*self._sides(some, pairs), s.similarity, s.min_size, self.bits, ["pair_id"])

    def compare_metadata(self, pairs: DataFrame, documents: DataFrame) -> DataFrame:
        meta = documents.dropDuplicates(["file_hash"])
        both = pairs.join(meta.select(F.col("file_hash").alias("hash_l"), F.col("metadata").alias("ml")), "hash_l").join(meta.select(F.col("file_hash").alias("hash_r"), F.col("metadata").alias("mr")), "hash_r")
        return J.compare_attributes(both, "ml", "mr", J.ATTRIBUTES, "pair_id")

    def compare(self, documents: DataFrame, sentences: DataFrame, images: DataFrame, tender: DataFrame | None = None, progress: Handler | None = None, pair_progress: dict[str, Callable[[str], Handler]] | None = None) -> DataFrame:
        """A result for each pair, in the store's schema; written to the store if there is one.

        The three comparisons are computed one after the other, each over all pairs; progress hears of each
        when it is done. pair_progress: "text", "image" or "metadata" to a function that gives a pair's id its
        handler, which hears of the pair's matches. files are paths, and hashes where documents have none.
        """
        began = time.time()
        steps, group = Progress(4, progress), uuid.uuid4().hex
        pairs = self.pairs(documents)
        side = lambda s: F.struct(F.col(f"{s}_text").alias("text"), F.col(f"{s}_marked").alias("textB"), F.col(f"{s}_page").alias("pageNumber"))
        sort = lambda order, value: F.transform(F.array_sort(F.collect_list(F.struct(*order, value.alias("v")))), lambda x: x["v"])
        kept: list[DataFrame] = []

        def done(name: str, matches: DataFrame, value: Column) -> DataFrame:
            logger.info("comparing %s", name)
            matches = matches.groupBy("pair_id").agg(value).persist(StorageLevel.DISK_ONLY)
            kept.append(matches)
            n = matches.agg(F.sum(F.size(matches.columns[1]))).first()[0] or 0
            logger.info("compared %s: %d matches", name, n)
            if pair_progress and name in pair_progress:
                for row in pairs.select("pair_id").join(matches.select("pair_id", F.size(matches.columns[1]).alias("n")), "pair_id", "left").toLocalIterator():
                    pair_progress[name](row["pair_id"])("1.0000", f"{row['n'] or 0} / {row['n'] or 0}", duration_text(0))
            steps.step()
            return matches

        texts = done("text", self.compare_texts(pairs, sentences, tender), sort(["a_ord", "b_ord"], F.struct(side("a").alias("a"), side("b").alias("b"), "similarity")).alias("textSimilarities"))
        image = F.struct(F.array("a_image", "b_image").alias("images"), F.array("a_page", "b_page").alias("pages"), "similarity")
        pictures = done("image", self.compare_images(pairs, images), sort(["a_ord", "b_ord"], image).alias("imageMatches"))
        label = F.array_position(F.array(*[F.lit(x) for _, x in J.ATTRIBUTES]), F.col("label"))
        meta = done("metadata", self.compare_metadata(pairs, documents), sort([label], F.struct("label", "a", "b", "same")).alias("metadataMatches"))
        s, ended = self.settings, time.time()
        path = F.coalesce(F.col("file_path"), F.col("file_hash")) if "file_path" in documents.columns else F.col("file_hash")
        at = documents.select(F.col("ord").alias("__ord"), path.alias("__path"))
        out = pairs.join(texts, "pair_id", "left").join(pictures, "pair_id", "left").join(meta, "pair_id", "left")
        for place, name in (("i", "path_l"), ("j", "path_r")):
            out = out.join(at.select(F.col("__ord").alias(place), F.col("__path").alias(name)), place)
        out = out.select(
            F.lit(group).alias("groupid"), F.col("pair_id").alias("uuid"), F.array("name_l", "name_r").alias("names"), F.array("path_l", "path_r").alias("files"),
            F.coalesce("textSimilarities", F.array().cast(f"array<{schemas.TEXT_MATCH}>")).alias("textSimilarities"), F.coalesce("imageMatches", F.array().cast(f"array<{schemas.IMAGE_MATCH}>")).alias("imageMatches"), F.coalesce("metadataMatches", F.array().cast(f"array<{schemas.METADATA_MATCH}>")).alias("metadataMatches"),
            F.lit(int(began * 1000)).alias("starttime"), F.lit(int(ended * 1000)).alias("addtime"), F.lit(int(ended * 1000) - int(began * 1000)).alias("duration"),
            F.struct(F.struct(F.lit(s.text.threshold).alias("threshold"), F.lit(s.text.min_length).alias("minLength")).alias("text"), F.struct(F.lit(s.image.similarity).alias("similarity"), F.lit(s.image.min_size).alias("minSize")).alias("image")).alias("settings"),
        )
        if self.store:
            self.store.append_results(out)
            out = self.store.results(group)
            for x in kept:
                x.unpersist()
        steps.step()
        logger.info("compared group %s", group)
        return out

    def compare_pair(self, documents: DataFrame, sentences: DataFrame, images: DataFrame, left: str, right: str, tender: DataFrame | None = None) -> DataFrame:
        """The result of two documents, by their file_hash; left and right keep that order."""
        some = documents.where(F.col("file_hash").isin(left, right)).dropDuplicates(["file_hash"]).withColumn("ord", F.when(F.col("file_hash") == left, 0).otherwise(1))
        if left == right:
            some = some.unionByName(some.withColumn("ord", F.lit(1)))
        own = lambda df: df.where(F.col("file_hash").isin(left, right))
        return self.compare(some, own(sentences), own(images), tender)

    def history(self, group: str | None = None) -> DataFrame:
        if not self.store:
            raise ValueError("there is no store")
        return self.store.results(group)


def sentences_of(documents: DataFrame, key: str = "file_hash", text: str = "text") -> DataFrame:
    """Sentences with vectors of documents that are plain text."""
    return with_vectors(line_sentences(documents, key, text))
