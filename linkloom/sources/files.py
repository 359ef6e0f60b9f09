"""State files, blob folders and exports."""

from __future__ import annotations

import json
import os
import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions.urls import page_id_parse, page_id_text
from linkloom.schemas import PAGES
from linkloom.storage import remove


def _texted(kind: T.DataType) -> T.DataType:
    """The same type with its timestamps as text."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _texted(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_texted(kind.elementType))
    return T.StringType() if isinstance(kind, T.TimestampNTZType) else kind


def parsed_stamp(text: Column) -> Column:
    """UTC timestamps as the state file writes them, cut to microseconds."""
    return F.regexp_replace(F.regexp_replace(text, r"(Z|\+00:00)$", ""), r"(\.[0-9]{6})[0-9]+$", "$1").try_cast("timestamp_ntz")


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """Page state: a Parquet folder as it is, or a state file ``{"pages": {id: page}}``, whose missing fields take their defaults.

    The single file is one value and so one task's work: a form to import from and to export to.
    State of any size lives in a folder.
    """
    if not path.endswith(".json"):
        return spark.read.schema(PAGES).parquet(path)
    stored = _texted(T.StructType([f for f in PAGES.fields if f.name != "page_id"]))
    raw = spark.read.text(path, wholetext=True)
    state = raw.select(F.from_json("value", T.StructType([T.StructField("pages", T.MapType(T.StringType(), stored))])).alias("s"))
    rows = state.select(F.explode("s.pages").alias("id", "p"))

    def button(b: Column) -> Column:
        hop = F.when(b["redirect"].isNotNull(), F.struct(b["redirect"]["from"].alias("from"), parsed_stamp(b["redirect"]["last_visited"]).alias("last_visited")))
        plain = [b[c].alias(c) for c in ("source", "hash", "file_ext", "target")]
        return F.struct(*plain, parsed_stamp(b["last_visited"]).alias("last_visited"), hop.alias("redirect"), b["alt"].alias("alt"), b["title"].alias("title"))

    none = lambda c: F.array().cast(PAGES[c].dataType)
    return rows.select(
        "p.url", page_id_parse(F.col("id")).alias("page_id"), parsed_stamp(F.col("p.last_visited")).alias("last_visited"), F.coalesce("p.failed", F.lit(0).cast("long")).alias("failed"),
        F.coalesce(F.transform("p.buttons", button), none("buttons")).alias("buttons"), F.coalesce("p.other_internal_links", none("other_internal_links")).alias("other_internal_links"), "p.redirects_to",
    )


def _stamp(value) -> str:
    return value.isoformat() + "Z"


def page_record(row) -> dict:
    """One page as the state file holds it: zero, empty and null values are left out, but a button's source and target never are."""
    out = {"url": row["url"], "last_visited": _stamp(row["last_visited"])}
    if row["failed"]:
        out["failed"] = row["failed"]
    buttons = []
    for b in row["buttons"] or []:
        one = {"source": b["source"], "hash": b["hash"], "file_ext": b["file_ext"], "target": b["target"], "last_visited": _stamp(b["last_visited"])}
        if b["redirect"]:
            one["redirect"] = {"from": b["redirect"]["from"], "last_visited": _stamp(b["redirect"]["last_visited"])}
        one |= {k: b[k] for k in ("alt", "title") if b[k] is not None}
        buttons.append(one)
    out["buttons"] = buttons
    if row["other_internal_links"]:
        out["other_internal_links"] = list(row["other_internal_links"])
    if row["redirects_to"] is not None:
        out["redirects_to"] = row["redirects_to"]
    return out


def write_state(pages: DataFrame, path: str) -> None:
    """K1: page state, written beside and renamed: a Parquet folder in id order, or a ``.json`` file, to which rows stream through the driver a partition at a time."""
    if not path.endswith(".json"):
        replace_folder(pages.repartitionByRange("page_id").sortWithinPartitions("page_id"), path)
        return
    ordered = pages.withColumn("id", page_id_text(F.col("page_id.host"), F.col("page_id.path"))).orderBy("page_id")
    with _replacing(path) as out:
        out.write('{\n  "pages": {')
        for i, row in enumerate(ordered.toLocalIterator()):
            out.write(("," if i else "") + "\n" + f"    {json.dumps(row['id'])}: {json.dumps(page_record(row), ensure_ascii=False)}")
        out.write("\n  }\n}\n")


def replace_folder(df: DataFrame, path: str) -> None:
    """``df`` as a Parquet folder that takes its place only once it is whole; readers of the old one must be done."""
    spark = df.sparkSession
    fresh, old = f"{path}-new", f"{path}-old"
    df.write.mode("overwrite").parquet(fresh)
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at(path)):
        remove(spark, [old])
        fs.rename(at(path), at(old))
    if not fs.rename(at(fresh), at(path)):
        raise OSError(f"{fresh} could not become {path}")
    remove(spark, [old])


class _replacing:
    """A file that takes its place only once it is whole."""

    def __init__(self, path: str, mode: str = "w"):
        self.path, self.mode = path, mode

    def __enter__(self):
        self.file = open(f"{self.path}.bak", self.mode, **({} if "b" in self.mode else {"encoding": "utf-8"}))
        return self.file

    def __exit__(self, kind, *rest):
        self.file.close()
        if kind is None:
            os.replace(f"{self.path}.bak", self.path)


def blob_names(spark: SparkSession, folder: str) -> DataFrame:
    """File names of a blob folder; contents are not read."""
    return spark.read.format("binaryFile").load(folder).select(F.substring_index("path", "/", -1).alias("filename"))


def blobs(spark: SparkSession, folder: str) -> DataFrame:
    """Stored images with hash and extension."""
    raw = spark.read.format("binaryFile").load(folder).select(F.substring_index("path", "/", -1).alias("f"), F.col("content").alias("bytes"))
    return raw.select(F.substring_index("f", ".", 1).alias("hash"), F.substring_index("f", ".", -1).alias("file_ext"), "bytes")


def restored(missing: DataFrame, got: DataFrame) -> DataFrame:
    """Downloaded images (source, hash, bytes) under the hash they were missed by and under their own."""
    found = missing.join(got.select(F.col("source").alias("url"), F.col("hash").alias("own"), "bytes"), "url")
    return found.select(F.explode(F.array_distinct(F.array("hash", "own"))).alias("hash"), "file_ext", "bytes").dropDuplicates(["hash", "file_ext"])


def missing_blobs(wanted: DataFrame, stored: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(hash, file_ext, url) to download again, from the first page's source."""
    first = occurrences.where(F.col("source").isNotNull()).groupBy("hash").agg(F.min_by("source", F.struct("host", "path", "pos")).alias("url"))
    return wanted.join(stored.select("hash", "file_ext"), ["hash", "file_ext"], "left_anti").join(first, "hash", "left")


def cbor(value) -> bytes:
    """K2: the definite-length encoding of numbers, text, arrays, maps, booleans and null."""
    if value is None or value is True or value is False:
        return bytes([0xF6 if value is None else 0xF5 if value else 0xF4])
    if isinstance(value, int):
        return _head(0, value) if value >= 0 else _head(1, -1 - value)
    if isinstance(value, float):
        return b"\xfb" + struct.pack(">d", value)
    if isinstance(value, bytes):
        return _head(2, len(value)) + value
    if isinstance(value, str):
        raw = value.encode()
        return _head(3, len(raw)) + raw
    if isinstance(value, dict):
        return _head(5, len(value)) + b"".join(cbor(k) + cbor(v) for k, v in value.items())
    return _head(4, len(value)) + b"".join(map(cbor, value))


def _head(major: int, n: int) -> bytes:
    if n < 24:
        return bytes([major << 5 | n])
    for code, size in ((24, 1), (25, 2), (26, 4), (27, 8)):
        if n < 1 << 8 * size:
            return bytes([major << 5 | code]) + n.to_bytes(size, "big")
    raise ValueError("too large")


#: The export's columns in order: (name, table, order, column, length of a whole inner array or None).
COLUMNS = (
    ("pages", "pages", "idx", "id", None), ("buttons", "buttons", "idx", "hash", None), ("texts", "texts", "idx", "text", None), ("button_file_exts", "button_file_exts", "idx", "file_ext", None),
    ("links", "page_links", "page", "links", "total"), ("link_buttons", "page_links", "page", "link_buttons", "total"), ("link_button_alts", "page_links", "page", "link_button_alts", "total"),
    ("link_button_titles", "page_links", "page", "link_button_titles", "total"), ("link_button_filenames", "page_links", "page", "link_button_filenames", "total"),
    ("backlinks", "page_backlinks", "page", "backlinks", "total"), ("backlink_buttons", "page_backlinks", "page", "backlink_buttons", "total"),
    ("button_links", "button_columns", "button", "button_links", "n_links"), ("button_backlinks", "button_columns", "button", "button_backlinks", "total"), ("button_names", "button_columns", "button", "button_names", "n_names"),
)


class _Json:
    """The export as text, value by value."""

    def __init__(self, out):
        self.out, self.first = out, [True]
        out.write("{")

    def _comma(self):
        if not self.first[-1]:
            self.out.write(", ")
        self.first[-1] = False

    def begin(self, name, n):
        self._comma()
        self.out.write(f"{json.dumps(name)}: [")
        self.first.append(True)

    def begin_inner(self, n):
        self._comma()
        self.out.write("[")
        self.first.append(True)

    def value(self, v):
        self._comma()
        self.out.write(json.dumps(v, ensure_ascii=False))

    def end(self):
        self.first.pop()
        self.out.write("]")

    def close(self):
        self.out.write("}")


class _Cbor:
    """The same in definite-length encoding: every length is known before its values come."""

    def __init__(self, out):
        self.out = out
        out.write(_head(5, len(COLUMNS)))

    def begin(self, name, n):
        self.out.write(cbor(name) + _head(4, n))

    def begin_inner(self, n):
        self.out.write(_head(4, n))

    def value(self, v):
        self.out.write(cbor(v))

    def end(self):
        pass

    def close(self):
        pass


def export(tables: dict[str, DataFrame], writers) -> None:
    """K2: the snapshot's parallel arrays to each writer; rows stream through the driver a partition at a time.

    No column is ever held whole; a page's or badge's arrays come chunk by chunk.
    """
    for name, source, key, column, length in COLUMNS:
        df = tables[source]
        if column == "id":
            df = df.select("idx", page_id_text(F.col("id.host"), F.col("id.path")).alias("id"))
        n = df.select(key).distinct().count()
        for w in writers:
            w.begin(name, n)
        if length is None:
            for row in df.select(key, column).orderBy(key).toLocalIterator():
                for w in writers:
                    w.value(row[column])
        else:
            last = None
            for row in df.select(key, "chunk", length, column).orderBy(key, "chunk").toLocalIterator():
                if row[key] != last:
                    for w in writers:
                        if last is not None:
                            w.end()
                        w.begin_inner(row[length])
                    last = row[key]
                for v in row[column]:
                    for w in writers:
                        w.value(v)
            if last is not None:
                for w in writers:
                    w.end()
        for w in writers:
            w.end()
    for w in writers:
        w.close()


def write_snapshot(tables: dict[str, DataFrame], folder: str, stats: dict) -> None:
    """K2, K3: the export as JSON and CBOR, each replaced whole, and the statistics."""
    with _replacing(f"{folder}/index.json") as text, _replacing(f"{folder}/index.cbor", "wb") as binary:
        export(tables, [_Json(text), _Cbor(binary)])
    with _replacing(f"{folder}/stats.json") as out:
        json.dump(stats, out)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """K5, K6: one value per line, as a folder of text parts."""
    df.select(column).write.mode("overwrite").text(path)


