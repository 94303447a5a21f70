"""Sharding by rendezvous hashing over weighted shards."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import pick
from cohortlens.session import materialize

# Hash blocks within a shard that are numbered side by side; a fixed share of the rows each.
SLOT_BLOCKS = 1024


def shard_score(key: Column, shard: Column, weight: Column) -> Column:
    """How strongly ``key`` is drawn to ``shard``: ``weight / -ln(u)``, ``u`` uniform from MD5 of both.

    The MD5 is that of ``key:shard``; ``u`` takes its first 52 bits. A shard receives keys in proportion to its weight.
    """
    text = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), shard.cast("string"))
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")
    return weight / -F.ln((bits + 0.5) / F.lit(2.0**52))


def choose(key: Column, shards: Mapping[int, float]) -> Column:
    """``struct(score, lower, shard)`` of the shard with the highest score; the smaller number wins a tie."""
    listed = F.array(*[F.struct(F.lit(int(s)).alias("shard"), F.lit(float(w)).alias("weight")) for s, w in sorted(shards.items()) if w > 0])
    scored = F.transform(listed, lambda n: F.struct(
        shard_score(key, n["shard"], n["weight"]).alias("score"), (-n["shard"]).alias("lower"), n["shard"].alias("shard")
    ))
    return F.array_max(scored)


def assign(df: DataFrame, key: str, shards: Mapping[int, float], grown: Mapping[int, float] | None = None) -> DataFrame:
    """``(key, shard)``, and ``grown_shard`` if further shards ``grown`` (number to weight) are given.

    Each row goes to the shard that scores highest for its key, so a key keeps its shard whatever the
    other rows are, removing a shard moves only its own rows, and a new shard takes rows only into itself.
    A null key counts as the empty text; equal keys share a shard; shards of weight 0 receive nothing.
    An empty table gives an empty result.
    """
    if not any(w > 0 for w in shards.values()):
        raise ValueError("no shard has a positive weight")
    rows = pick(df, key=key).withColumn("best", choose(F.col("key"), shards))
    out = [F.col("key").alias(key), F.col("best.shard").alias("shard")]
    if grown:
        both = rows.withColumn("new", choose(F.col("key"), grown))
        bigger = F.array_max(F.array("best", "new"))
        return both.select(*out, bigger["shard"].alias("grown_shard"))
    return rows.select(*out)


def with_slots(df: DataFrame, key: str, shard: str = "shard", blocks: int = SLOT_BLOCKS) -> DataFrame:
    """Add ``slot``: 0, 1, 2, ... without gaps in every shard, whatever the size of the shard.

    A shard is dealt into ``blocks`` hash blocks of its keys. Block sizes are counted first (merged
    before the shuffle), their running sums are at most ``shards x blocks`` rows, and rows are numbered
    inside their block only. ``df`` is read twice: hand in a stored table. Rows with one key are numbered
    next to each other in any order.
    """
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    block = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % blocks).cast("int")
    rows = df.withColumn("__block", block)
    sizes = rows.groupBy(shard, "__block").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(shard).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(shard, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    order = Window.partitionBy(shard, "__block").orderBy(F.col(key).asc_nulls_first())
    numbered = rows.withColumn("__at", F.row_number().over(order) - 1)
    return numbered.join(starts, [shard, "__block"]).withColumn("slot", F.col("__start") + F.col("__at")).drop("__block", "__at", "__start")


def shard_documents(df: DataFrame, shards: Mapping[int, float], grown: Mapping[int, float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, shard, grown_shard, slot`` for every row of ``df``, by key.

    ``size`` is the UTF-8 length of the text plus 16, ``text_crc32`` its unsigned checksum; a null text counts
    as empty. Texts are read once; what is stored and shuffled afterwards is one short row per document. Rows that repeat a key
    share its shard, each with a slot of its own; rows without a key are placed like those of one key more; an empty table gives an
    empty result.
    """
    rows = pick(df, key=key, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("best", choose(F.col("key"), shards))
    bigger = F.array_max(F.array("best", choose(F.col("key"), grown)))["shard"] if grown else F.lit(None).cast("int")
    narrow = rows.select(
        "key",
        (F.octet_length("text") + 16).cast("long").alias("size"),
        F.crc32("text").alias("text_crc32"),
        F.col("best.shard").alias("shard"),
        bigger.alias("grown_shard"),
    )
    return with_slots(materialize(narrow, "sharded"), "key").withColumnRenamed("key", key)
