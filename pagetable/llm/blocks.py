"""Rows that share a key, dealt in pairs of blocks so that no key makes a large group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_pairs(rows: DataFrame, key: list[str], ident: str, size: int = 256) -> DataFrame:
    """`rows` of keys that at least two rows have, once per pair of blocks that their block belongs to.

    A key with n rows is cut into ceil(n / size) blocks by a hash of `ident`. Every pair of blocks (a block with
    itself included) is a group `g` of about 2 * size rows at most; `side` tells the two blocks apart (1 and 2;
    0 where a block meets itself). So two rows of a key meet in exactly one group. `g` is a hash: two groups
    may share it, so callers compare the key where that matters.
    """
    counts = rows.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1")
    blocks = F.ceil(F.col("_n") / size).cast("int")
    dealt = rows.join(counts, key).withColumn("_nb", blocks)
    dealt = dealt.withColumn("_own", F.pmod(F.xxhash64(ident, F.lit(17)), "_nb").cast("int"))
    dealt = dealt.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    group = F.xxhash64(*key, F.least("_own", "_with"), F.greatest("_own", "_with"))
    side = F.when(F.col("_own") == F.col("_with"), 0).when(F.col("_own") < F.col("_with"), 1).otherwise(2)
    return dealt.select(group.alias("g"), side.alias("side"), *rows.columns)


def together(dealt: DataFrame) -> DataFrame:
    """The groups of `block_pairs`, each whole and in sequence within a partition."""
    return dealt.repartition("g").sortWithinPartitions("g")
