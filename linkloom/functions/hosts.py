"""Host lists and rate-limit keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.config import DEFAULT_DELAY_S, RATE_RULES
from linkloom.functions.urls import host_of


def host_in(host: Column, hosts: Sequence[str]) -> Column:
    """P5: the host is one of a list, or a subdomain of one."""
    return reduce(lambda a, b: a | b, ((host == h) | host.endswith("." + h) for h in hosts), F.lit(False))


def url_host_in(url: Column, hosts: Sequence[str]) -> Column:
    """As ``host_in``, of a URL's domain; addresses of numbers have none, and ``www.`` stays."""
    host = host_of(url)
    number = host.rlike(r"^[0-9.]+$") | host.startswith("[")
    return host_in(F.when(number, F.lit("")).otherwise(host), hosts)


def shorten_host(host: Column) -> Column:
    """P20: without its first label if it has more than two, else null."""
    parts = F.split(host, r"\.")
    return F.when(F.size(parts) > 2, F.array_join(F.slice(parts, 2, F.greatest(F.lit(1), F.size(parts) - 1)), "."))


def rate_key(host: Column) -> Column:
    """Struct of the limiter's key and its delay in seconds.

    Labels are dropped from the left until a rule matches or two are left, so the longest rule wins.
    """
    by_length = sorted(RATE_RULES, key=lambda r: -len(r[0]))
    key, delay = F.substring_index(host, ".", -2), F.lit(DEFAULT_DELAY_S)
    for rule, seconds in reversed(by_length):
        hit = (host == rule) | host.endswith("." + rule)
        key, delay = F.when(hit, F.lit(rule)).otherwise(key), F.when(hit, F.lit(seconds)).otherwise(delay)
    return F.struct(key.alias("rate_key"), delay.cast("int").alias("delay_s"))


def host_is_plain(host: Column) -> Column:
    """Q1: only ASCII letters, digits, dots and hyphens."""
    return host.rlike(r"^[A-Za-z0-9.-]*$")
