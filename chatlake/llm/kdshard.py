"""Sharding by a K-d tree of the documents' metadata.

Every document is a point: its metadata columns as numbers in [0, 1] (strings by
their first bytes, in order), weighted by its size.  A node of the tree that
stands for k > 1 shards is cut along its widest dimension at the weighted
quantile that gives floor(k / 2) of the k shards their part of the bytes (the
weighted median where k is even), until each leaf is one shard, so all leaves reach
the same target bytes.

The quantile comes from two histograms, each one aggregation over all rows:
``BINS`` bins of the dimension find the bin that holds it, and ``TIES`` hash bins
of the rows in that bin divide them.  So a value that a third of all rows share
is cut like any other, and a cut misses its quantile by the weight of one hash bin
at most.  Nothing is collected: a level's cuts are a table with a row for each
node, which is broadcast (there are fewer nodes than shards, at most
``MAX_SHARDS``).

Law: ``bytes`` - shard sizes are near equal.

Nulls and edge cases: a null text has no bytes (a row counts 8 more); a null in a
dimension stands before all values; a constant or all-null dimension has no
width; equal rows fall into the same hash bin and so the same shard; with fewer
documents than shards some shards stay empty; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, rank_in_groups

BINS = 4096
TIES = 65536
MAX_SHARDS = 100_000
DIMENSIONS = ("source", "lang", "doc_id", "n_chars")


def _number(df: DataFrame, name: str) -> Column:
    """A string's first six bytes as a number keep its order; times and numbers are themselves."""
    c, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        head = F.rpad(F.hex(F.substring(c.cast("binary"), 1, 6)), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, T.BooleanType):
        return c.cast("int").cast("double")
    return c.cast("double")


def points(docs: DataFrame, id_col: str, text_col: str, dims: tuple[str, ...]) -> DataFrame:
    """``_id``, ``_size``, ``_crc``, ``_c`` (coordinates) and ``_tie`` (hash bin) of every document."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    raw = docs.select(
        F.col(f"`{id_col}`").alias("_id"), (F.octet_length(text) + 8).cast("long").alias("_size"), F.crc32(text).alias("_crc"),
        F.pmod(F.xxhash64(text, F.col(f"`{id_col}`")), F.lit(TIES)).cast("int").alias("_tie"),
        F.array(*[F.nanvl(_number(docs, d), F.lit(None).cast("double")) for d in dims]).alias("_raw"))
    raw = cut(raw)
    n = range(len(dims))
    low, high = (raw.agg(F.array(*[f(F.col("_raw")[i]) for i in n])).scalar() for f in (F.min, F.max))
    raw = raw.withColumns({"_lo": low, "_hi": high})
    scaled = F.transform("_raw", lambda x, i: F.coalesce(
        F.when(F.get(F.col("_hi"), i) > F.get(F.col("_lo"), i),
               (x - F.get(F.col("_lo"), i)) / (F.get(F.col("_hi"), i) - F.get(F.col("_lo"), i))), F.lit(0.0)))
    return raw.select("_id", "_size", "_crc", "_tie", scaled.alias("_c"))


def _cuts(t: DataFrame, dims: int) -> DataFrame:
    """One row for each node of two shards or more: where it is cut."""
    spans = t.where("_k > 1").groupBy("_node", "_k").agg(
        F.sum("_size").alias("_total"), F.array(*[F.min(F.col("_c")[i]) for i in range(dims)]).alias("_min"),
        F.array(*[F.max(F.col("_c")[i]) for i in range(dims)]).alias("_max"))
    widths = F.zip_with("_max", "_min", lambda a, b: a - b)
    nodes = spans.select(
        F.col("_node").alias("_n"), F.floor(F.col("_k") / 2).cast("int").alias("_left"),
        (F.col("_total") * F.floor(F.col("_k") / 2) / F.col("_k")).alias("_target"),
        (F.array_position(widths, F.array_max(widths)) - 1).cast("int").alias("_dim"), "_min", F.array_max(widths).alias("_width"))
    nodes = cut(nodes.withColumn("_from", F.get("_min", F.col("_dim"))).drop("_min"))
    rows = t.join(F.broadcast(nodes), F.col("_node") == F.col("_n")).withColumn("_bin", _bin())
    upto = Window.partitionBy("_n").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    at = (rows.groupBy("_n", "_bin").agg(F.sum("_size").alias("_w"), F.first("_target").alias("_target"))
          .withColumn("_upto", F.sum("_w").over(upto))
          .where((F.col("_upto") >= F.col("_target")) & (F.col("_upto") - F.col("_w") < F.col("_target")))
          .select(F.col("_n").alias("_n1"), F.col("_bin").alias("_cut_bin"), (F.col("_upto") - F.col("_w")).alias("_before")))
    inside = rows.join(F.broadcast(at), (F.col("_n") == F.col("_n1")) & (F.col("_bin") == F.col("_cut_bin")))
    upto = Window.partitionBy("_n").orderBy("_tie").rowsBetween(Window.unboundedPreceding, 0)
    over = F.col("_before") + F.col("_upto")
    tie = (inside.groupBy("_n", "_tie").agg(F.sum("_size").alias("_w"), F.first("_target").alias("_target"),
                                            F.first("_before").alias("_before"), F.first("_cut_bin").alias("_cut_bin"))
           .withColumn("_upto", F.sum("_w").over(upto))
           .where((over >= F.col("_target")) & (over - F.col("_w") < F.col("_target")))
           .select(F.col("_n").alias("_n2"), "_cut_bin",
                   F.when(over - F.col("_target") < F.col("_target") - (over - F.col("_w")), F.col("_tie") + 1)
                   .otherwise(F.col("_tie")).alias("_cut_tie")))
    return cut(nodes.join(tie, F.col("_n") == F.col("_n2")).drop("_n2", "_target"))


def _bin() -> Column:
    place = F.floor((F.get("_c", F.col("_dim")) - F.col("_from")) / F.col("_width") * BINS)
    return F.when(F.col("_width") > 0, F.least(place, F.lit(BINS - 1))).otherwise(F.lit(0)).cast("int")


def tree(points_: DataFrame, shards: int, dims: int) -> DataFrame:
    """Points with ``shard``: leaves from left to right."""
    if not 1 <= shards <= MAX_SHARDS:
        raise ValueError(f"shards must be from 1 to {MAX_SHARDS}")
    t = points_.withColumns({"_node": F.lit(0).cast("long"), "_k": F.lit(shards), "_first": F.lit(0)})
    for _ in range((shards - 1).bit_length()):
        cuts = _cuts(t, dims)
        j = t.join(F.broadcast(cuts), F.col("_node") == F.col("_n"), "left")
        left = (_bin() < F.col("_cut_bin")) | ((_bin() == F.col("_cut_bin")) & (F.col("_tie") < F.col("_cut_tie")))
        right = F.col("_n").isNotNull() & ~left
        half = F.coalesce("_left", F.lit(0))
        t = j.select(*points_.columns, (F.col("_node") * 2 + right.cast("long")).alias("_node"),
                     F.when(F.col("_n").isNull(), F.col("_k")).when(right, F.col("_k") - half).otherwise(half).alias("_k"),
                     F.when(right, F.col("_first") + half).otherwise(F.col("_first")).alias("_first"))
    return t.withColumnRenamed("_first", "shard").drop("_node", "_k")


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id",
          text_col: str = "text", dims: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """One row for each document: the id, ``size``, ``text_crc32``, ``shard`` and
    ``slot`` (gapless from 0 in its shard).  The number of shards is given, or
    follows from the bytes that a leaf shall reach."""
    p = points(docs, id_col, text_col, dims)
    if shards is None:
        shards = max(1, -(-(p.agg(F.sum("_size").alias("s")).first()["s"] or 0) // target_bytes))
    placed = cut(tree(p, shards, len(dims)).select("_id", "_size", "_crc", "_tie", "shard"))
    own = placed.groupBy(F.col("shard").alias("_s")).agg(F.count(F.lit(1)).alias("_rows"))       # at most MAX_SHARDS rows
    counted = placed.join(F.broadcast(own), F.col("shard") == F.col("_s")).drop("_s")
    out = rank_in_groups(counted, ["shard"], ["_tie", "_id", "_crc"], "slot", F.col("_rows"))
    return out.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), "shard", "slot")
