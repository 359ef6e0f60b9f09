"""The dictionary-encoded index: O5, U1 to U3, J5 to J9, A4 to A9.

``occ`` holds button occurrences (host, path, pos, hash, file_ext, source, target, alt, title,
last_visited); ``redirects`` holds (host, path, to_host, to_path).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.config import DEFAULT, CrawlConfig
from linkloom.functions.urls import page_id, source_filename
from linkloom.operators.running import numbered
from linkloom.storage import discard, written

#: Pages whose occurrences of one key are sorted together.
STRETCH = 4096


def dense_index(values: DataFrame, column: str) -> DataFrame:
    """Distinct values numbered from 0 in order, without sorting them all in one task.

    Values are range-partitioned and stored; per-partition counts, one row per partition, give
    each partition its offset, and rows are numbered inside it.
    """
    spread = values.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(column)
    kept = written(spread.withColumn("__part", F.spark_partition_id()), "index")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = kept.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(column)) - 1
    return kept.join(offsets, "__part").select(column, (F.col("__offset") + place).cast("long").alias("idx"))


def resolved(occ: DataFrame, redirects: DataFrame) -> DataFrame:
    """Page and target each follow at most one redirect; targets become page ids."""
    hop = redirects.select(F.struct("host", "path").alias("from"), F.struct(F.col("to_host").alias("host"), F.col("to_path").alias("path")).alias("to"))
    own = occ.withColumn("src", F.struct("host", "path")).withColumn("dst", F.when(F.col("target").isNotNull(), page_id(F.col("target"))))
    for end in ("src", "dst"):
        step = hop.select(F.col("from").alias(end), F.col("to").alias("__to"))
        own = own.join(step, end, "left").withColumn(end, F.coalesce("__to", end)).drop("__to")
    return own


def page_dictionary(occ: DataFrame, redirects: DataFrame) -> DataFrame:
    """Crawled pages, link targets and redirect targets."""
    ids = occ.select(F.struct("host", "path").alias("id"))
    ids = ids.union(occ.where(F.col("target").isNotNull()).select(page_id(F.col("target")).alias("id")))
    ids = ids.union(redirects.select(F.struct(F.col("to_host").alias("host"), F.col("to_path").alias("path")).alias("id")))
    return dense_index(ids, "id")


def button_dictionary(occ: DataFrame) -> DataFrame:
    """U3."""
    return dense_index(occ.select("hash"), "hash")


def text_dictionary(occ: DataFrame) -> DataFrame:
    """Alternative texts, titles and file names."""
    texts = F.array_compact(F.array("alt", "title", source_filename(F.col("source"))))
    return dense_index(occ.select(F.explode(texts).alias("text")), "text")


def file_exts(occ: DataFrame) -> DataFrame:
    """A4: one extension per hash, that of the latest visit, ties to the greatest."""
    return occ.groupBy("hash").agg(F.max_by("file_ext", F.struct("last_visited", "file_ext")).alias("file_ext"))


def encoded(occ: DataFrame, redirects: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The occurrence fact with dictionary indexes, and the dictionaries.

    Occurrences and dictionaries are stored once and read by every lookup. Lookups are plain
    equi-joins; small dictionaries become broadcasts by their measured size. ``own_idx`` is the
    page's own number, before any redirect, by which its occurrences are ordered.
    """
    occ = written(occ.select("host", "path", "pos", "hash", "source", "target", "alt", "title").withColumn("filename", source_filename(F.col("source"))), "occurrences")
    dicts = {"pages": page_dictionary(occ, redirects), "buttons": button_dictionary(occ), "texts": text_dictionary(occ)}
    dicts = {name: written(d, f"index-{name}") for name, d in dicts.items()}
    ids = dicts["pages"]
    own = resolved(occ, redirects).withColumn("own", F.struct("host", "path"))
    fact = own.join(ids.select(F.col("id").alias("own"), F.col("idx").alias("own_idx")), "own")
    fact = fact.join(ids.select(F.col("id").alias("src"), F.col("idx").alias("src_idx")), "src")
    fact = fact.join(ids.select(F.col("id").alias("dst"), F.col("idx").alias("dst_idx")), "dst", "left")
    fact = fact.join(dicts["buttons"].select("hash", F.col("idx").alias("button_idx")), "hash")
    for c in ("alt", "title", "filename"):
        fact = fact.join(dicts["texts"].select(F.col("text").alias(c), F.col("idx").alias(f"{c}_idx")), c, "left")
    return fact.select("own_idx", "pos", "src_idx", "dst_idx", "button_idx", "alt_idx", "title_idx", "filename_idx"), dicts


def _field(name: str):
    return lambda x: x[name]


def _chunked(fact: DataFrame, key: str, item: Sequence[str | Column], chunk: int) -> DataFrame:
    """(key, chunk, total, a): occurrences in order, ``chunk`` to a row, so that no row grows with a page or badge."""
    placed = numbered(fact, key, F.floor(F.col("own_idx") / STRETCH), ["own_idx", "pos"])
    rows = placed.groupBy(key, F.floor(F.col("nth") / chunk).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("nth", *item))).alias("a"))
    return rows.withColumn("total", F.sum(F.size("a")).over(Window.partitionBy(key)))


def _every_page(rows: DataFrame, key: str, n_pages: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Pages without a row keep one empty chunk."""
    empty = F.array().cast("array<bigint>")
    both = n_pages.select(F.col("idx").alias("page")).join(rows, F.col(key) == F.col("page"), "left")
    return both.select("page", F.coalesce("chunk", F.lit(0)).cast("long").alias("chunk"), F.coalesce("total", F.lit(0)).cast("long").alias("total"), *(F.coalesce(F.transform("a", _field(c)), empty).alias(n) for n, c in columns.items()))


def forward_links(fact: DataFrame, n_pages: DataFrame, config: CrawlConfig = DEFAULT) -> DataFrame:
    """A5: five aligned arrays per page, in order of page and position, by chunks of them; pages without links keep empty ones."""
    rows = _chunked(fact, "src_idx", ["dst_idx", "button_idx", "alt_idx", "title_idx", "filename_idx"], config.chunk_links)
    names = {"links": "dst_idx", "link_buttons": "button_idx", "link_button_alts": "alt_idx", "link_button_titles": "title_idx", "link_button_filenames": "filename_idx"}
    return _every_page(rows, "src_idx", n_pages, names)


def back_links(fact: DataFrame, n_pages: DataFrame, config: CrawlConfig = DEFAULT) -> DataFrame:
    """Aligned arrays of linking pages and their buttons per target page, by chunks of them."""
    rows = _chunked(fact.where(F.col("dst_idx").isNotNull()), "dst_idx", ["src_idx", "button_idx"], config.chunk_links)
    return _every_page(rows, "dst_idx", n_pages, {"backlinks": "src_idx", "backlink_buttons": "button_idx"})


def button_columns(fact: DataFrame, buttons: DataFrame, config: CrawlConfig = DEFAULT) -> DataFrame:
    """Per button its targets, its pages and its names (alt, title, file name per occurrence), by chunks of occurrences.

    ``n_links``, ``total`` and ``n_names`` are the whole columns' lengths.
    """
    names = F.array_compact(F.array("alt_idx", "title_idx", "filename_idx")).alias("names")
    rows = _chunked(fact, "button_idx", ["src_idx", "dst_idx", names], config.chunk_links)
    rows = rows.select(
        "button_idx", "chunk", "total",
        F.array_compact(F.transform("a", _field("dst_idx"))).alias("button_links"), F.transform("a", _field("src_idx")).alias("button_backlinks"), F.flatten(F.transform("a", _field("names"))).alias("button_names"),
    )
    whole = Window.partitionBy("button_idx")
    rows = rows.withColumn("n_links", F.sum(F.size("button_links")).over(whole)).withColumn("n_names", F.sum(F.size("button_names")).over(whole))
    return buttons.select(F.col("idx").alias("button"), "hash").join(rows, F.col("button_idx") == F.col("button")).select("button", "hash", "chunk", "total", "n_links", "n_names", "button_links", "button_backlinks", "button_names")


def button_file_exts(buttons: DataFrame, occ: DataFrame) -> DataFrame:
    """Each button's extension by its number."""
    return buttons.join(file_exts(occ), "hash").select("idx", "hash", "file_ext")


def snapshot(occ: DataFrame, redirects: DataFrame, config: CrawlConfig = DEFAULT) -> dict[str, DataFrame]:
    """§2.13: every table of the index, each with its row's number in ``page``, ``button`` or ``idx``, stored."""
    fact, dicts = encoded(occ, redirects)
    fact = written(fact, "snapshot")
    made = {
        "page_links": forward_links(fact, dicts["pages"], config),
        "page_backlinks": back_links(fact, dicts["pages"], config),
        "button_columns": button_columns(fact, dicts["buttons"], config),
        "button_file_exts": button_file_exts(dicts["buttons"], occ),
    }
    made = {name: written(t, name) for name, t in made.items()}
    discard(fact)
    return dicts | made
