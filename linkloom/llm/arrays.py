"""Array expressions shared by the native operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def running_starts(lengths: Column, block: int = 256) -> Column:
    """Running totals of an array of lengths, from 0, one more than there are lengths.

    Arrays are summed in blocks, so that the copying that appending costs stays linear in the
    number of lengths times the block.
    """
    zero = F.lit(0).cast("bigint")
    blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(lengths), F.lit(1)), F.lit(block)), lambda i: F.slice(lengths, i, block))
    grow = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    totals = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda acc, x: acc + x))
    offsets = F.aggregate(totals, F.array(zero), grow)
    inside = F.zip_with(blocks, F.slice(offsets, 1, F.size(blocks)), lambda b, o: F.slice(F.aggregate(b, F.array(o), grow), 2, block))
    return F.concat(F.array(zero), F.flatten(inside))
