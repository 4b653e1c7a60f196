"""Masks and lookups: identity, range, prefix and facet predicates. A mask is a table of ids; None is no mask at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import folded


def exact_lookup(docs: DataFrame, key: str, id_col: str, digest: Column | None = None, names: list[str] = ()) -> DataFrame:
    """(id, score 1): by digest for a ``sha256:`` key, else by equality of a folded name."""
    if key.startswith("sha256:"):
        keep = digest == F.lit(key)
    else:
        keep = F.lit(False)
        for n in names:
            keep = keep | (folded(F.col(n)) == F.lit(key.strip().lower()))
    return docs.where(keep).select(F.col(id_col).alias("id"), F.lit(1.0).alias("score"))


def range_scan(docs: DataFrame, key: str, low=None, high=None, prefix: str | None = None) -> DataFrame:
    """Rows whose key is in the window, both ends included, or starts with the prefix; a null key never is."""
    out = docs.where(F.col(key).isNotNull())
    out = out if low is None else out.where(F.col(key) >= low)
    out = out if high is None else out.where(F.col(key) <= high)
    return out if prefix is None else out.where(F.startswith(F.col(key), F.lit(prefix)))


def facet_clause(column: str | Column, values: list, every: bool = False, negate: bool = False, array: bool = False) -> Column:
    """ANY or ALL of the values in a scalar facet, or with ``array`` in one that holds several. Null facets match only a negated
    clause. A scalar holds all of the values only if they are one."""
    c = F.col(column) if isinstance(column, str) else column
    wanted = list(dict.fromkeys(values))
    held = F.array(*map(F.lit, wanted))
    if array:
        hit = F.size(F.array_except(held, c)) == 0 if every else F.arrays_overlap(c, held)
    else:
        hit = (c == F.lit(wanted[0]) if len(wanted) == 1 else F.lit(False)) if every else c.isin(wanted)
    hit = F.coalesce(hit & c.isNotNull(), F.lit(False))
    return ~hit if negate else hit


def facet_filter(rows: DataFrame, column: str, values: list, every: bool = False, negate: bool = False) -> DataFrame:
    """The rows that the clause admits, whether the column is an array or not."""
    return rows.where(facet_clause(column, values, every, negate, dict(rows.dtypes)[column].startswith("array")))


def ids_or_keys(identities: DataFrame, blocks: DataFrame, ids: list = (), keys: list[tuple[str, str]] = ()) -> DataFrame:
    """(id): the blocks asked for by id, and those that an identity names: (key, value) pairs, folded."""
    out = blocks.where(F.col("block_id").isin(list(ids))).select(F.col("block_id").alias("id"))
    for key, value in keys:
        out = out.unionByName(identities.where((F.col("key") == key) & (F.col("value") == F.lit(value.strip().lower()))).select(F.col("block_id").alias("id")))
    return out.distinct()


def federated_mask(hits: DataFrame, owners: DataFrame, masks: dict[str, DataFrame | None]) -> DataFrame:
    """Hits (id, ...) that a module which owns them admits. ``owners``: (id, memory_type); a module without a mask admits all."""
    free = [m for m, mask in masks.items() if mask is None]
    admitted = owners.where(F.col("memory_type").isin(free) | ~F.col("memory_type").isin(list(masks))).select("id")
    for m, mask in masks.items():
        if mask is not None:
            admitted = admitted.unionByName(owners.where(F.col("memory_type") == m).join(mask.select("id"), "id", "left_semi").select("id"))
    return hits.join(admitted.distinct(), "id", "left_semi")


def masked(rows: DataFrame, mask: DataFrame | None) -> DataFrame:
    """Rows whose id is in the mask; without a mask, all."""
    return rows if mask is None else rows.join(mask.select("id"), "id", "left_semi")


def listing(rows: DataFrame, key: str, contains: str | None, columns: list[str], offset: int, limit: int) -> DataFrame:
    """One page of rows in order of the key, of those that hold a text in one of the columns."""
    if contains:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(contains.lower())), F.lit(False))
        rows = rows.where(hit)
    return rows.orderBy(key).offset(offset).limit(limit)
