"""Explicit schemas; JSON and Parquet are never read by inference."""

from __future__ import annotations

from pyspark.sql import types as T

PAGE_ID = T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType())])
REDIRECT = T.StructType([T.StructField("from", T.StringType()), T.StructField("last_visited", T.TimestampNTZType())])
BUTTON = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("hash", T.StringType()),
        T.StructField("file_ext", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("last_visited", T.TimestampNTZType()),
        T.StructField("redirect", REDIRECT),
        T.StructField("alt", T.StringType()),
        T.StructField("title", T.StringType()),
    ]
)
PAGES = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("page_id", PAGE_ID),
        T.StructField("last_visited", T.TimestampNTZType()),
        T.StructField("failed", T.LongType()),
        T.StructField("buttons", T.ArrayType(BUTTON)),
        T.StructField("other_internal_links", T.ArrayType(T.StringType())),
        T.StructField("redirects_to", T.StringType()),
    ]
)
RESPONSES = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("body", T.BinaryType()),
        T.StructField("fetched_at", T.TimestampNTZType()),
    ]
)
EDGES = T.StructType(
    [
        T.StructField("src", PAGE_ID),
        T.StructField("dst", PAGE_ID),
        T.StructField("weight", T.DoubleType()),
        T.StructField("dst_url", T.StringType()),
        T.StructField("kind", T.StringType()),
    ]
)
