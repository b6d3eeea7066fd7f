"""Percentiles of groups by radix selection.

A floating value becomes an integer that sorts as it does. Its leading bits are a histogram's bins: counts of bins are
all that is kept of a part of the data (a slice, a file, a day), and parts combine by adding them up. From such a
histogram any percentile is known within one bin. To know it exactly, the next digit is counted, but only of the values
whose leading bits are those of a bin that a wanted rank falls in, and so on to the last digit.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.operators.current import is_number
from voxelloom.runtime import Scratch, fresh

DIGIT = 16
MANTISSA = 52
BIAS = 1023
SMALL_BLOCK = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often it occurs."""
    return F.get(F.transform(F.array(value), body), 0)


def ordered_bits(value: Column) -> Column:
    """The 64 bits of a finite double as a bigint that sorts as the double does; -0.0 is 0.0. Null if not finite.

    Scaling by powers of two is exact. The logarithm may be rounded over a power of two: then the scaled value is just
    under 1, or 2 or more, instead of from 1 to 2, and the mantissa counts twice, or half. Below the least exponent it
    counts once.
    """
    value = value.cast("double")

    def of(size: Column) -> Column:
        return _let(F.greatest(F.floor(F.log2(size)).cast("int"), F.lit(1 - BIAS)), lambda e: _let(scaled(size, e), lambda m: joined(m, e)))

    def scaled(size: Column, exponent: Column) -> Column:
        half = F.shiftright(exponent, 1)
        return size * F.pow(F.lit(2.0), -half) * F.pow(F.lit(2.0), half - exponent)

    def joined(m: Column, exponent: Column) -> Column:
        under = F.least(m - 1, F.lit(0.0)) * (exponent > 1 - BIAS).cast("double")
        over = F.least(1 - m / 2, F.lit(0.0))
        return F.shiftleft((exponent + BIAS).cast("bigint"), MANTISSA) + (((m - 1) + under + over) * float(1 << MANTISSA)).cast("bigint")

    # Of a value that isn't finite the size is taken as 0, and the result left out afterwards.
    good = is_number(value)
    below = F.coalesce(value < 0, F.lit(False)).cast("bigint")
    return _let(of(F.abs(F.when(good, value).otherwise(F.lit(0.0)))), lambda bits: bits * (1 - 2 * below) - below) + F.when(good, F.lit(0).cast("bigint"))


def from_ordered_bits(bits: Column) -> Column:
    """The double that ordered_bits() gives these bits for."""
    own = F.when(bits < 0, F.bitwise_not(bits)).otherwise(bits)
    exponent = F.shiftright(own, MANTISSA).cast("int")
    mantissa = own.bitwiseAND(F.lit((1 << MANTISSA) - 1)).cast("double") / float(1 << MANTISSA)
    power = exponent - BIAS
    half = F.floor(power / 2).cast("int")
    normal = (1 + mantissa) * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), power - half)
    tiny = mantissa * F.pow(F.lit(2.0), F.lit(-1022))
    size = F.when(exponent == 0, tiny).otherwise(normal)
    return F.when(bits < 0, -size).otherwise(size)


def radix_histogram(df: DataFrame, keys: list[str], value: str | Column, bits: int = DIGIT, *, ordered: bool = False) -> DataFrame:
    """(keys, bin, n): counts of the finite values of each group by their leading `bits` bits.

    Values that are null, not a number or infinite are not counted; a group without others has no rows. A bin of b bits
    is narrower than its values by 2 ** (12 - b) or more, b > 12: that is the greatest relative error of a percentile.
    Partial counts are made before the shuffle, so the size of a group doesn't matter. Nulls in a key are a group. With
    `ordered`, the value is what ordered_bits() gave.
    """
    value = F.col(value) if isinstance(value, str) else value
    bin_ = F.shiftright(value if ordered else ordered_bits(value), 64 - bits).alias("bin")
    return df.where(value.isNotNull() if ordered else is_number(value.cast("double"))).select(*keys, bin_).groupBy(*keys, "bin").agg(F.count("*").alias("n"))


def merge_histograms(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """One histogram of several with the same number of bits, or of one with more keys than `keys`."""
    whole = reduce(DataFrame.unionByName, [p.select(*keys, "bin", "n") for p in parts])
    return whole.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))


def _cumulated(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """The histogram with the number of values up to each bin; a group has at most 2 ** bits bins."""
    w = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return histogram.withColumn("upto", F.sum("n").over(w))


def histogram_percentiles(histogram: DataFrame, keys: list[str], quantiles: list[float], bits: int = DIGIT) -> DataFrame:
    """(keys, quantile, n, estimate, lower, upper): of each group the value with the rank ceil(quantile * n).

    lower <= true value <= upper; the estimate is the middle of the bin. n is the number of values counted.
    """
    total = Window.partitionBy(*keys)
    cells = _cumulated(histogram, keys).withColumn("total", F.sum("n").over(total))
    wanted = F.explode(F.array(*(F.lit(float(q)) for q in quantiles))).alias("quantile")
    cells = cells.select(*keys, "bin", "n", "upto", "total", wanted)
    rank = F.greatest(F.lit(1), F.ceil(F.col("quantile") * F.col("total")))
    hit = cells.where((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank))
    low = from_ordered_bits(F.shiftleft("bin", 64 - bits))
    high = from_ordered_bits(F.shiftleft(F.col("bin"), 64 - bits) + F.lit((1 << (64 - bits)) - 1))
    return hit.select(*keys, "quantile", F.col("total").alias("n"), ((low + high) / 2).alias("estimate"), low.alias("lower"), high.alias("upper"))


def select_ranks(values: DataFrame, keys: list[str], value: str, targets: DataFrame, *, histogram: DataFrame | None = None, ordered: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """(keys, rank, value): the exact value with each wanted rank (1 = smallest) of its group, by four digits of 16 bits.

    `targets` has the keys and `rank`; repeated ones count once; ranks below 1 or beyond the number of finite values of
    the group, and nulls in a key, give no row. Each digit's histogram counts only the values under the prefixes that
    ranks have been followed to, so all but the first pass over few of them. With `ordered`, `value` holds what
    ordered_bits() gave, which is then computed once and not in each of the first two passes.
    """
    scratch = scratch or Scratch(values.sparkSession, "radix")
    (bits, prefix, rest, whole, block) = fresh([*keys, "rank", "bin", "n", "upto"], "value_bits", "prefix", "rest", "whole", "block")
    if ordered:
        data = values.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias(bits))
    else:
        data = values.where(is_number(F.col(value).cast("double"))).select(*keys, ordered_bits(F.col(value)).alias(bits))
    counts = histogram if histogram is not None else scratch.save(data.groupBy(*keys, F.shiftright(bits, 64 - DIGIT).alias("bin")).agg(F.count("*").alias("n")), "bins")
    totals = counts.groupBy(*keys).agg(F.sum("n").alias(whole))
    state = targets.select(*keys, "rank").where(F.col("rank") >= 1).distinct().join(totals, keys)
    state = state.withColumn(rest, F.col("rank")).withColumn(prefix, F.lit(0).cast("bigint")).where(F.col(rest) <= F.col(whole))
    # Ranks meet bins by blocks of ranks, so that neither many ranks nor many bins of one group come together at once:
    # a group has at most 2 ** DIGIT + 1 blocks, and a small one no more than its values by SMALL_BLOCK.
    width = F.greatest(F.lit(SMALL_BLOCK), F.ceil(F.col(whole) / (1 << DIGIT)))
    for step in range(1, 64 // DIGIT + 1):
        under = keys if step == 1 else [*keys, prefix]
        if step > 1:
            followed = state.select(*under).distinct()
            data = data.withColumn(prefix, F.shiftright(bits, 64 - DIGIT * (step - 1))).join(followed, under, "left_semi")
            if step == 2:
                data = scratch.save(data, "followed")
            # The sign is in the first digit; later digits count from 0.
            digit = F.shiftright(bits, 64 - DIGIT * step).bitwiseAND(F.lit((1 << DIGIT) - 1))
            counts = data.groupBy(*under, digit.alias("bin")).agg(F.count("*").alias("n"))
        cells = _cumulated(counts, under).withColumn(whole, F.sum("n").over(Window.partitionBy(*under)))
        blocks = F.sequence(F.floor((F.col("upto") - F.col("n")) / width), F.floor((F.col("upto") - 1) / width))
        cells = cells.withColumn(block, F.explode(blocks)).drop(whole)
        hit = state.withColumn(block, F.floor((F.col(rest) - 1) / width)).join(cells, [*under, block]).where((F.col("upto") >= F.col(rest)) & (F.col("upto") - F.col("n") < F.col(rest)))
        longer = F.col("bin") if step == 1 else F.shiftleft(prefix, DIGIT) + F.col("bin")
        state = scratch.save(hit.select(*keys, "rank", (F.col(rest) - (F.col("upto") - F.col("n"))).alias(rest), longer.alias(prefix), F.col("n").alias(whole)), f"digit{step}")
    return state.select(*keys, "rank", from_ordered_bits(F.col(prefix)).alias("value"))
