"""Naming rows by what they hold, and leaving rows out without moving the texts of the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a list (24 bytes each) up to which it may be broadcast.
BROADCAST_KEYS = 1_000_000


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, whatever its case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key() -> Column:
    """A hash of id and text: the same for rows that repeat, whatever order they are read in. With the id beside it a row's name: texts that collide would have to share their id too."""
    return F.xxhash64(F.lit("row"), F.col("doc_id"), F.col("doc_id").isNull(), F.col("text"), F.col("text").isNull())


def matched(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """``docs`` joined (left_anti or left_semi) with ``keys`` (row_key and doc_id, kept beforehand): broadcast if few, else by shuffle."""
    k, i = fresh("_row_key", docs), fresh("_row_id", docs)
    keys = keys.select(F.col("row_key").alias(k), F.col("doc_id").alias(i))
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return docs.join(keys, (row_key() == F.col(k)) & F.col("doc_id").eqNullSafe(F.col(i)), how)


def without_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` whose row isn't in ``keys``."""
    return matched(docs, keys, "left_anti")
