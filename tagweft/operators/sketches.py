"""Sketches of node tables that can be merged: how many distinct values there are, from 2**bits registers a group.

A value's hash chooses a register and bids the number of its leading zeros (HyperLogLog). The registers are rows, kept by a
plain `max`: partial sums before the shuffle, merging of sketches that were stored, and any order of merging are the same
aggregate. The estimate is off by 1.04 / sqrt(2**bits) on average; small numbers are counted by the empty registers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 12


def registers(rows: DataFrame, value: Column, by: list[str], bits: int = BITS) -> DataFrame:
    """by, register, rank: the sketch of each group. Null values don't count."""
    h = F.xxhash64(F.lit(0), value)
    register = F.shiftrightunsigned(h, 64 - bits).cast("int")
    rest = F.shiftleft(h, bits)
    # leading zeros of what is left of the hash: the binary digits of a positive number are as many as its length
    zeros = F.when(rest == 0, 64 - bits).when(rest < 0, 0).otherwise(64 - F.length(F.bin(rest)))
    bids = rows.where(value.isNotNull()).select(*by, register.alias("register"), (zeros + 1).cast("int").alias("rank"))
    return bids.groupBy(*by, "register").agg(F.max("rank").alias("rank"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of coarser groups, or of several tables put together."""
    return sketches.groupBy(*by, "register").agg(F.max("rank").alias("rank"))


def estimated(sketches: DataFrame, by: list[str], bits: int = BITS) -> DataFrame:
    """by, estimate."""
    m = 1 << bits
    sums = sketches.groupBy(*by).agg(F.count("*").alias("used"), F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("harmonic"))
    raw = (0.7213 / (1 + 1.079 / m)) * m * m / (F.coalesce("harmonic", F.lit(0)) + (m - F.col("used")))
    linear = m * F.log(m / (m - F.col("used")))
    return sums.select(*by, F.when((raw <= 2.5 * m) & (F.col("used") < m), linear).otherwise(raw).alias("estimate"))
