"""Garbage collection and re-keying of stored images."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.config import DEFAULT, CrawlConfig
from linkloom.functions.images import Normalizer, content_hash, identity_normalizer, re_encoded
from linkloom.storage import remove, written


def linked_filenames(occurrences: DataFrame) -> DataFrame:
    return occurrences.select(F.concat_ws(".", "hash", "file_ext").alias("filename")).distinct()


def unlinked(blobs: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Stored files that no page links."""
    return blobs.join(linked_filenames(occurrences), "filename", "left_anti")


def delete_files(spark: SparkSession, root: str, filenames: Iterable[str], apply: bool = False) -> int:
    """M7: how many files of a folder would be deleted, one by one and only if asked to, wherever the folder is."""
    n = 0
    for name in filenames:
        n += 1
        if apply:
            remove(spark, [f"{root}/{name.rpartition('/')[2]}"])
    return n


def pages_of_hash(occurrences: DataFrame, config: CrawlConfig = DEFAULT) -> DataFrame:
    """(hash, part, pages): the pages of each image, in parts of about ``chunk_links`` where there are more."""
    pages = written(occurrences.select("hash", F.struct("host", "path").alias("page")).distinct(), "pages-of-hash")
    parts = pages.groupBy("hash").agg(F.ceil(F.count("*") / config.chunk_links).alias("parts"))
    dealt = pages.join(parts, "hash").withColumn("part", F.pmod(F.xxhash64("page"), F.col("parts")))
    return dealt.groupBy("hash", "part").agg(F.sort_array(F.collect_list("page")).alias("pages"))


def rekeyed(occurrences: DataFrame, mapping: DataFrame) -> DataFrame:
    """Occurrences under the new hash and extension of ``mapping`` (old_hash, new_hash, new_ext)."""
    found = occurrences.join(mapping, F.col("hash") == F.col("old_hash"), "left")
    return found.withColumn("hash", F.coalesce("new_hash", "hash")).withColumn("file_ext", F.coalesce("new_ext", "file_ext")).drop("old_hash", "new_hash", "new_ext")


def rekeyed_pages(pages: DataFrame, mapping: DataFrame) -> DataFrame:
    """M8: page state whose buttons have the new hashes and extensions; other pages are passed on."""
    button = pages.schema["buttons"].dataType.elementType
    held = pages.select("page_id", F.posexplode("buttons").alias("pos", "b")).select("page_id", "pos", "b.*")
    made = F.struct("pos", F.struct(*(F.col(f.name) for f in button.fields)).alias("b"))
    fresh = rekeyed(held, mapping).groupBy("page_id").agg(F.array_sort(F.collect_list(made)).alias("__a"))
    both = pages.join(fresh, "page_id", "left").withColumn("__new", F.transform("__a", lambda x: x["b"]).cast(pages.schema["buttons"].dataType))
    return both.select(*(F.coalesce("__new", "buttons").alias(c) if c == "buttons" else F.col(c) for c in pages.columns))


def reencode(blobs: DataFrame, normalizer: Normalizer = identity_normalizer) -> tuple[DataFrame, DataFrame]:
    """M8: re-encoded blobs and the mapping of changed hashes; old blobs are never deleted here."""
    fresh = blobs.select(F.col("hash").alias("old_hash"), F.col("file_ext").alias("new_ext"), re_encoded(F.col("bytes"), F.col("file_ext"), normalizer).alias("bytes")).where(F.octet_length("bytes") > 0)
    fresh = fresh.withColumn("new_hash", content_hash(F.col("bytes")))
    stored = fresh.select(F.col("new_hash").alias("hash"), F.col("new_ext").alias("file_ext"), "bytes").dropDuplicates(["hash", "file_ext"])
    return stored, fresh.where("old_hash <> new_hash").select("old_hash", "new_hash", "new_ext")
