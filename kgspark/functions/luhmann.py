"""Hierarchical ids: grammar, depth, parent, and the id of the n-th child."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAMMAR = r"^[0-9]+([a-z][0-9]*|\.[0-9]+[a-z]?)*$"
_TOKEN = r"([0-9]+|[a-z]+)"


def is_valid(c: Column) -> Column:
    return F.lower(c).rlike(GRAMMAR)


def depth(c: Column) -> Column:
    """Number of runs of digits or letters; null counts 0."""
    return F.coalesce(F.size(F.regexp_extract_all(F.lower(c), F.lit(_TOKEN), 1)), F.lit(0)).cast("bigint")


def valid_depth(c: Column) -> Column:
    return F.when(is_valid(c), depth(c))


def parent(c: Column) -> Column:
    """The id without its last level; null where there is none."""
    low = F.lower(c)
    up = F.regexp_replace(low, r"([.][0-9]+|[a-z]+|[0-9]+)$", "")
    return F.when(is_valid(c) & (up != ""), up)


def letters(n: Column) -> Column:
    """1 -> a, 26 -> z, 27 -> aa: bijective base 26, for up to three letters."""
    ch = lambda x: F.chr((x + 97).cast("bigint"))
    m = n - 1
    one, two, three = m, m - 26, m - 26 - 676
    return (
        F.when(n <= 26, ch(one))
        .when(n <= 702, F.concat(ch(F.floor(two / 26)), ch(F.pmod(two, F.lit(26)))))
        .otherwise(F.concat(ch(F.floor(three / 676)), ch(F.floor(F.pmod(three, F.lit(676)) / 26)), ch(F.pmod(three, F.lit(26)))))
    )


def child_id(parent_id: Column, n: Column) -> Column:
    """Id of the n-th child: ``1`` -> ``1.n``; after a digit letters; after a letter numbers."""
    num = n.cast("string")
    return (
        F.when(parent_id.isNull(), num)
        .when(parent_id.rlike(r"^[0-9]+$"), F.concat(parent_id, F.lit("."), num))
        .when(parent_id.rlike(r"[0-9]$"), F.concat(parent_id, letters(n)))
        .when(parent_id.rlike(r"[a-z]$"), F.concat(parent_id, num))
        .otherwise(F.concat(parent_id, F.lit(".1")))
    )


def sort_key(c: Column) -> Column:
    """Siblings and roots in natural order: shorter first, then by text."""
    return F.struct(F.length(c), c)


def root_number(c: Column) -> Column:
    """The leading number of a root id; 9999 where there is none."""
    return F.coalesce(F.regexp_extract(c, r"^[0-9]+", 0).try_cast("int"), F.lit(9999))
