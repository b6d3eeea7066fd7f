"""Mixing sources to target weights by systematic sampling.

A source that should give more or less than it has is used at a rate: the expected copies of each of its documents. The
expected copies are summed up along the documents of the source, one random offset is added, and a document is emitted
once for every whole number that the sum crosses at it. So each document comes out the rate rounded down or up times,
and the source as often as it should but for one.

What counts is the size reached, and a few long documents could decide it. So a source is sampled in strata, the longest
documents first, each stratum at the rate that what is still wanted then asks for: shorter documents make up for what
longer ones gave too much or too little. Within a stratum documents are sorted by size by parts, and of some random
offsets the one that leaves the least to be made up is taken.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.runtime import Scratch

PART_ROWS = 100_000

#: Strata end at documents of these parts of what their source should give.
STRATA = (8, 64, 1024)
OFFSETS = 16


def _unit(seed: int, *of: Column) -> Column:
    """A number in [0, 1) that only depends on the seed and the columns."""
    return F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 40)) / float(1 << 40)


def mix_plan(sizes: DataFrame, targets: DataFrame, *, total: int | None = None, rescale: bool = False) -> DataFrame:
    """(source, target_share, max_repeats, documents, available, wanted, rate), a row for each row of `targets`.

    `sizes` is (source, size), `targets` is (source, target_share, max_repeats) with one row a source. `wanted` is the
    share of `total`, by default the size of all rows (one number, summed up at once), those without a source or of
    sources not in `targets` included. With `rescale` it is the share of the greatest total for which no source with
    documents lacks any, so that the mixture has the shares. rate = least(max_repeats, wanted / available). Null or
    negative sizes count as 0; a null target_share is 0 and a null or negative max_repeats is 0. Rows of `targets`
    without a source are left out.
    """
    size = F.greatest(F.coalesce(F.col("size"), F.lit(0)), F.lit(0))
    have = sizes.groupBy("source").agg(F.count("*").alias("documents"), F.sum(size).cast("bigint").alias("available"))
    wants = targets.where(F.col("source").isNotNull()).select("source", F.coalesce("target_share", F.lit(0.0)).cast("double").alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).cast("bigint").alias("max_repeats"))
    plan = wants.join(have, "source", "left").select("source", "target_share", "max_repeats", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("documents", "available")))
    if rescale:
        most = F.floor(F.min(F.col("max_repeats") * F.col("available") / F.col("target_share"))).cast("bigint")
        total = plan.where("documents > 0 and target_share > 0").agg(most).first()[0] or 0
    elif total is None:
        total = sizes.agg(F.sum(size)).first()[0] or 0
    plan = plan.withColumn("wanted", F.col("target_share") * F.lit(total).cast("bigint"))
    needed = F.when(F.col("available") > 0, F.col("wanted") / F.col("available")).when(F.col("wanted") > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))
    return plan.withColumn("rate", F.least(F.col("max_repeats").cast("double"), needed))


def _copies(offset: str = "offset") -> str:
    """Whole numbers that the sum of expected copies crosses at a place: both ends as the neighbours compute them. As SQL,
    like all that is said for each offset, for the driver builds it much faster."""
    return f"cast(least(floor(place * rate + {offset}) - floor((place - 1) * rate + {offset}), cap) as bigint)"


def mix(documents: DataFrame, targets: DataFrame, *, total: int | None = None, rescale: bool = False, seed: int = 7, part_rows: int = PART_ROWS, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(copies, report). `documents` is (doc_id, source, size), `targets` as in mix_plan.

    copies: (doc_id, source, size, copies), a row for each document that is used, 1 <= copies <= max_repeats.
    report: mix_plan with what was reached: (…, used_documents, copies, reached, reached_share, short). A source is short
    if it gives less than wanted though each of its documents is used max_repeats times, or if it has no documents.

    Repeated rows of a doc_id are documents of their own. A stratum is cut into parts by hash, so that no task sorts all
    of a large one; the number of documents before each part is added to the places in it. Tables by source and stratum are
    written, so Spark knows their size and sends them to all tasks only where they are small.
    """
    scratch = scratch or Scratch(documents.sparkSession, "mix")
    docs = scratch.save(documents.select("doc_id", "source", F.greatest(F.coalesce(F.col("size"), F.lit(0)), F.lit(0)).cast("bigint").alias("size")), "documents")
    plan = scratch.save(mix_plan(docs, targets, total=total, rescale=rescale), "plan")
    used = plan.where("rate > 0").select("source", "max_repeats", "wanted")
    stratum = reduce(lambda x, k: x + (F.col("size") * k <= F.col("wanted")).cast("int"), STRATA, F.lit(0))
    drawn = docs.join(used, "source").withColumn("stratum", stratum)
    sums = scratch.save(drawn.groupBy("source", "stratum").agg(F.count("*").alias("n"), F.sum("size").alias("tokens"), F.first("max_repeats").alias("cap"), F.first("wanted").alias("wanted")), "strata")
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / part_rows))
    placed = drawn.join(sums.select("source", "stratum", parts.alias("parts")), ["source", "stratum"]).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("parts")))
    by = ["source", "stratum", "part"]
    # A window of as many rows as a stratum has parts.
    before = F.sum("n").over(Window.partitionBy("source", "stratum").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = placed.groupBy(*by).agg(F.count("*").alias("n")).select(*by, F.coalesce(before, F.lit(0)).alias("before"))
    here = Window.partitionBy(*by).orderBy("size", "doc_id")
    placed = placed.select("doc_id", "size", *by, F.row_number().over(here).alias("row")).join(starts, by)
    placed = scratch.save(placed.select("doc_id", "source", "size", "stratum", (F.col("before") + F.col("row")).alias("place")), "placed")
    chosen = _chosen(placed, sums, seed, scratch)
    copies = F.expr(_copies())
    out = scratch.save(placed.join(chosen, ["source", "stratum"]).select("doc_id", "source", "size", copies.alias("copies")).where("copies > 0"), "copies")
    reached = out.groupBy("source").agg(F.count("*").alias("used_documents"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("size")).alias("reached"))
    zero = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("used_documents", "copies", "reached")}
    mixed = out.agg(F.sum(F.col("copies") * F.col("size"))).first()[0] or 0
    share = F.col("reached") / F.lit(mixed) if mixed else F.lit(0.0)
    spent = F.col("copies") == F.col("max_repeats") * F.col("documents")
    short = (F.col("documents") == 0) | (spent & (F.col("reached") < F.col("wanted")))
    return out, plan.join(reached, "source", "left").withColumns(zero).withColumns({"reached_share": share, "short": short})


def _chosen(placed: DataFrame, sums: DataFrame, seed: int, scratch: Scratch) -> DataFrame:
    """(source, stratum, cap, rate, offset), from the longest documents' stratum to the shortest': a row a source and stratum."""
    need, out = None, None
    for k in range(len(STRATA) + 1):
        here, later = sums.where(F.col("stratum") == k), sums.where(F.col("stratum") > k).groupBy("source").agg(F.sum("tokens").alias("later"))
        state = here.join(later, "source", "left").withColumn("later", F.coalesce("later", F.lit(0)))
        state = state.withColumn("need", F.col("wanted")) if need is None else state.join(need, "source", "left").withColumn("need", F.greatest(F.lit(0.0), F.col("wanted") - F.coalesce("given", F.lit(0))))
        rest = F.col("tokens") + F.col("later")
        rate = F.least(F.col("cap").cast("double"), F.when(rest > 0, F.col("need") / rest).when(F.col("need") > 0, F.lit(float("inf"))).otherwise(F.lit(0.0)))
        state = state.select("source", "stratum", "cap", "need", "later", rate.alias("rate"), _unit(seed, F.col("source"), F.col("stratum")).alias("unit"))
        # `missed` is what is given too much, or can't be made up for by the later strata; `off` is for the last stratum.
        offsets = [f"(unit + {i / OFFSETS}D) % 1D" for i in range(OFFSETS)]
        tried = placed.where(F.col("stratum") == k).join(state, ["source", "stratum"]).groupBy("source").agg(*(F.expr(f"sum({_copies(o)} * size) as t{i}") for i, o in enumerate(offsets)))
        missed = "greatest(t{i} - need, need - t{i} - cap * later, 0D) as missed, if(later = 0, abs(need - t{i}), 0D) as off"
        options = F.expr("array(" + ", ".join(f"struct({missed.format(i=i)}, {i} as i, t{i} as tokens, {o} as offset)" for i, o in enumerate(offsets)) + ")")
        best = scratch.save(state.join(tried, "source").withColumn("best", F.array_min(options)).select("source", "stratum", "cap", "rate", "best.offset", "best.tokens"), f"best{k}")
        out = best if out is None else out.unionByName(best)
        need = out.groupBy("source").agg(F.sum("tokens").alias("given"))
    return out.drop("tokens")
