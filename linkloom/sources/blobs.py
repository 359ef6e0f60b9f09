"""Stored images as a table of contents, in generations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators.maintenance import unlinked
from linkloom.operators.state import new_blobs
from linkloom.storage import remove

BLOBS = "hash string, file_ext string, bytes binary"


class BlobTable:
    """Images by content hash under one folder, wherever Spark can write.

    New contents are appended to the present generation. Collecting garbage writes the next
    generation without the unlinked ones and then drops the one before, so that a crash in
    between loses nothing: the generation to be read is the last one that is whole.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _generation(self) -> int:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
        whole = [int(n.removeprefix("gen-")) for n in names if n.startswith("gen-") and n.removeprefix("gen-").isdigit()]
        return max(whole, default=0)

    def _rename(self, old: str, new: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        if not path(old).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).rename(path(old), path(new)):
            raise OSError(f"{old} could not become {new}")

    def table(self) -> DataFrame:
        generation = self._generation()
        if not generation:
            return self.spark.createDataFrame([], BLOBS)
        return self.spark.read.schema(BLOBS).parquet(f"{self.root}/gen-{generation}")

    def names(self) -> DataFrame:
        return self.table().select(F.concat_ws(".", "hash", "file_ext").alias("filename"))

    def add(self, images: DataFrame) -> None:
        """K4: contents that aren't stored yet."""
        new_blobs(images, self.table()).write.mode("append").parquet(f"{self.root}/gen-{self._generation() or 1}")

    def replace(self, contents: DataFrame) -> None:
        """``contents`` as the next generation; the one before goes once it is whole."""
        generation = self._generation()
        fresh = f"{self.root}/new-{uuid.uuid4().hex}"
        contents.select("hash", "file_ext", "bytes").write.parquet(fresh)
        self._rename(fresh, f"{self.root}/gen-{generation + 1}")
        if generation:
            remove(self.spark, [f"{self.root}/gen-{generation}"])

    def collect(self, occurrences: DataFrame) -> int:
        """Drops what no page links; how many there were."""
        gone = unlinked(self.names(), occurrences)
        n = gone.count()
        if n:
            name = F.concat_ws(".", "hash", "file_ext")
            self.replace(self.table().withColumn("filename", name).join(gone, "filename", "left_anti"))
        return n
