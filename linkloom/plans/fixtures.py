"""Derived views over the driver tables, with the same text in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkloom.session import table

_ITEM = "concat(p_name, ' ', p_brand, ' ', p_type)"

VIEWS = {
    "edges": """
SELECT concat('s', CAST(l_suppkey AS STRING)) AS src, concat('p', CAST(l_partkey AS STRING)) AS dst,
       CAST(CASE l_returnflag WHEN 'N' THEN 1.0 WHEN 'A' THEN 0.1 ELSE 0.02 END AS DOUBLE) AS weight
FROM {lineitem}
UNION ALL
SELECT concat('p', CAST(l_partkey AS STRING)), concat('s', CAST(l_suppkey AS STRING)), CAST(1.0 AS DOUBLE)
FROM {lineitem} WHERE l_returnflag <> 'N'
UNION ALL
SELECT concat('s', CAST(s_suppkey AS STRING)), concat('s', CAST(s_suppkey AS STRING)), CAST(1.0 AS DOUBLE) FROM {supplier}""",
    "button_occ": f"""
SELECT concat('s', CAST(l_suppkey AS STRING), '.example') AS host,
       concat('p', CAST(l_linenumber AS STRING)) AS path,
       CAST(row_number() OVER (PARTITION BY l_suppkey, l_linenumber
            ORDER BY l_orderkey, l_partkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_returnflag, l_linestatus) - 1 AS BIGINT) AS pos,
       substr(<sha>{_ITEM}</sha>, 1, 32) AS hash,
       CASE WHEN p_partkey % 2 = 0 OR (l_linestatus = 'F' AND p_size < 10) THEN 'gif' ELSE 'png' END AS file_ext,
       CASE WHEN l_quantity < 3 THEN NULL ELSE concat('http://s', CAST(l_suppkey AS STRING), '.example/img/', replace(p_name, ' ', '_'), '.gif') END AS source,
       CASE WHEN l_returnflag = 'R' THEN NULL ELSE concat('https://www.s', CAST(l_orderkey % 10 AS STRING), '.example/p', CAST(l_linenumber AS STRING), '/') END AS target,
       CASE WHEN l_discount > 0.05 THEN p_name END AS alt,
       CASE WHEN l_discount < 0.02 THEN p_type END AS title,
       l_shipdate AS last_visited
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey""",
    "redirects": """
SELECT concat('s', CAST(s_suppkey AS STRING), '.example') AS host, 'p1' AS path,
       concat('s', CAST(s_suppkey + 3 AS STRING), '.example') AS to_host, 'p1' AS to_path
FROM {supplier} WHERE s_suppkey % 3 = 0""",
    "page_state": """
SELECT concat('http://www.c', CAST(o_custkey AS STRING), '.example/') AS url,
       concat('c', CAST(o_custkey AS STRING), '.example') AS host, '' AS path,
       max(o_orderdate) AS last_visited, CAST(o_custkey % 12 AS BIGINT) AS failed
FROM {orders} GROUP BY o_custkey""",
    "rate_requests": """
SELECT event_id, CAST(event_id * 500 AS BIGINT) AS t_ms, concat('u', CAST(user_id AS STRING), CASE event_type WHEN 'view' THEN '.neocities.org' WHEN 'click' THEN '.jcink.net' ELSE '.example.com' END) AS host
FROM {events}""",
    "blobs": f"""
SELECT DISTINCT concat(substr(<sha>{_ITEM}</sha>, 1, 32), CASE WHEN p_partkey % 2 = 0 THEN '.gif' ELSE '.png' END) AS filename FROM {{part}}
UNION SELECT concat('orphan', CAST(s_suppkey AS STRING), '.gif') FROM {{supplier}}""",
    # One row per image occurrence of a token stream, with sizes, alternative texts and repeats.
    "img_tokens": """
SELECT concat('g', CAST(l_suppkey AS STRING)) AS page, CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS pos,
       concat(CASE WHEN l_linenumber = 5 THEN 'ftp' ELSE 'http' END, '://h', CAST(l_suppkey AS STRING), '.example/', CAST(l_partkey AS STRING),
              CASE WHEN l_linenumber = 3 THEN '.svg' WHEN l_linenumber = 4 THEN '.ico' ELSE '.gif' END) AS url,
       CASE WHEN l_returnflag = 'A' THEN '' WHEN l_returnflag = 'R' THEN concat('alt', CAST(l_linenumber AS STRING)) END AS alt,
       CASE WHEN l_linestatus = 'F' THEN '' ELSE 'title' END AS title,
       CASE WHEN l_quantity < 10 THEN '88' WHEN l_quantity < 20 THEN '+088' WHEN l_quantity < 30 THEN '88px' WHEN l_quantity < 35 THEN '90' END AS width,
       CASE WHEN l_tax < 0.04 THEN '31' WHEN l_tax < 0.05 THEN ' 31' WHEN l_tax < 0.06 THEN '99999999999' WHEN l_tax < 0.07 THEN '32' END AS height
FROM {lineitem}""",
    # Markup by position, beside what it stands for: the image, the hrefs of its anchors.
    "html_tokens": """
SELECT page, url, pos, img_url, CASE WHEN kind IN (0, 1, 3, 5) THEN alt END AS alt, CASE WHEN kind IN (0, 1, 3, 5) THEN title END AS title,
       CASE WHEN kind IN (0, 1, 3, 5) THEN width END AS width, CASE WHEN kind IN (0, 1, 3, 5) THEN height END AS height, href, outer_href,
       CASE kind WHEN 0 THEN image WHEN 1 THEN concat('<a href="', href, '"><b>', image, '</b></a>') WHEN 2 THEN concat('<a href="/in', CAST(n AS STRING), '?ref=x">text</a>')
         WHEN 3 THEN concat('<a href="/out', CAST(n AS STRING), '">a<a href="/in', CAST(n AS STRING), '">', image, '</a></a>')
         WHEN 4 THEN concat('<template><a href="/hidden">', image, '</a></template>') WHEN 5 THEN concat('<a href="mailto:x@y">', image, '</a>') ELSE '<a href="#top">up</a><img src="e.ico">' END AS markup
FROM (SELECT *, concat('<img src="', src, '"', coalesce(concat(' alt="', alt, '"'), ''), coalesce(concat(' title="', title, '"'), ''), coalesce(concat(' width="', width, '"'), ''), coalesce(concat(' height=', height), ''), '>') AS image,
        CASE WHEN kind IN (0, 1, 3, 5) THEN concat('http://s', CAST(page AS STRING), '.example/dir/', src) WHEN kind = 6 THEN concat('http://s', CAST(page AS STRING), '.example/dir/e.ico') END AS img_url,
        CASE kind WHEN 1 THEN CASE WHEN n % 5 = 0 THEN concat('http://s', CAST(page AS STRING), '.example/dir/', src) WHEN n % 5 = 1 THEN concat('http://s', CAST(page AS STRING), '.example/in', CAST(n AS STRING)) ELSE concat('http://t', CAST(n AS STRING), '.example/') END
          WHEN 2 THEN concat('http://s', CAST(page AS STRING), '.example/in', CAST(n AS STRING)) WHEN 3 THEN concat('http://s', CAST(page AS STRING), '.example/in', CAST(n AS STRING)) END AS href,
        CASE WHEN kind = 3 THEN concat('http://s', CAST(page AS STRING), '.example/out', CAST(n AS STRING)) END AS outer_href
      FROM (SELECT l_suppkey AS page, concat('http://s', CAST(l_suppkey AS STRING), '.example/dir/') AS url, CAST(l_partkey % 23 AS BIGINT) AS n, CAST((l_orderkey + l_linenumber) % 7 AS INT) AS kind,
        CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax) AS BIGINT) AS pos,
        concat('i', CAST(l_partkey % 29 AS STRING), CASE WHEN l_partkey % 29 = 3 THEN '.svg' ELSE '.gif' END) AS src,
        CASE WHEN l_returnflag = 'A' THEN '' WHEN l_returnflag = 'R' THEN concat('alt', CAST(l_linenumber AS STRING)) END AS alt, CASE WHEN l_linestatus = 'F' THEN 'title' END AS title,
        CASE WHEN l_quantity < 15 THEN '88' WHEN l_quantity < 25 THEN '88px' WHEN l_quantity < 30 THEN '90' END AS width, CASE WHEN l_tax < 0.03 THEN '31' WHEN l_tax < 0.04 THEN 'x' WHEN l_tax < 0.05 THEN '32' END AS height
        FROM {lineitem}) AS raw) AS made""",
    "candidates": """
SELECT concat('c', CAST(s_suppkey AS STRING)) AS page, CAST(n AS BIGINT) AS pos, concat('u', CAST(n AS STRING)) AS url,
       (n * 7 + s_suppkey) % 61 = 0 AND s_suppkey % 4 <> 0 OR (s_suppkey % 4 = 0 AND n = 49) AS valid
FROM {supplier} JOIN (SELECT DISTINCT o_custkey AS n FROM {orders}) ON n < 95 + s_suppkey % 60""",
}


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name].replace("<sha>", "sha2(").replace("</sha>", ", 256)")
    used = [t for t in ("lineitem", "supplier", "part", "orders", "events") if "{" + t + "}" in text]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def duck_view(name: str) -> str:
    text = VIEWS[name].replace("<sha>", "sha256(").replace("</sha>", ")")
    for t in ("lineitem", "supplier", "part", "orders", "events"):
        text = text.replace("{" + t + "}", t)
    return f"({text})"
