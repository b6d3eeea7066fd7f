"""The queries of this subpackage, by problem. The SQL that must give the same rows is in sql.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.llm import clusters, sql
from voxelloom.llm.hooking import link_groups
from voxelloom.llm.mixing import mix
from voxelloom.llm.packing import pack_documents
from voxelloom.llm.percentiles import DIGIT, histogram_percentiles, merge_histograms, ordered_bits, radix_histogram, select_ranks
from voxelloom.llm.repetition import above_level, adaptive_thresholds, rank_error, repetition_shares, repetitive, share_sketches
from voxelloom.llm.tokens import with_token_counts
from voxelloom.llm.topn import top_n
from voxelloom.operators.current import SLICE, current_rows, is_number, stack_key
from voxelloom.runtime import Scratch

SQL = sql.SQL
GROUP = ["image_id", "scene", "stack_name"]


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _current_regions(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    regions = _table(spark, d, "regions").select("region_id", "ingested_at", *columns)
    out = current_rows(regions, "region_id", "ingested_at").drop("ingested_at")
    return out.withColumn("stack_name", stack_key(F.col("stack_name"))) if "stack_name" in columns else out


# Problem 1


def _clustered(spark: SparkSession, d: str) -> DataFrame:
    """(id, cluster, distance) of every current region: area by ratio, and form. Values that can't be are missing."""
    regions = _current_regions(spark, d, "area", "circularity", "eccentricity", "solidity")
    shape = {c: F.when(F.col(c) >= 0, F.col(c)) for c in ("circularity", "eccentricity", "solidity")}
    features = {"log_area": F.when(F.col("area") > 0, F.log("area")), **shape}
    scratch = Scratch(spark, "clusters")
    model, data = clusters.fit(regions, "region_id", features, scratch=scratch)
    return scratch.save(clusters.assign(data, model), "members")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    members = _clustered(spark, d).where("cluster is not null")
    probes = _table(spark, d, "similarity_probes")
    for side in "ab":
        probes = probes.join(members.select(F.col("id").alias(f"region_id_{side}"), F.col("cluster").alias(f"cluster_{side}")), f"region_id_{side}")
    return probes.where("cluster_a = cluster_b").select("region_id_a", "region_id_b")


def p1_members(spark: SparkSession, d: str) -> DataFrame:
    """The cluster of every region and the distance from its centroid; strays have neither."""
    return _clustered(spark, d).select(F.col("id").alias("region_id"), "cluster", "distance")


def p1_clusters(spark: SparkSession, d: str) -> DataFrame:
    """The clusters with their sizes and the regions nearest their centroids."""
    return clusters.describe(_clustered(spark, d))


def p1_checks(spark: SparkSession, d: str) -> DataFrame:
    """All regions, and whether the clusters' sizes and typical members are those that counting the members gives."""
    members = Scratch(spark, "p1").save(p1_members(spark, d), "members")
    lists = clusters.describe(members.withColumnRenamed("region_id", "id"))
    sizes = members.where("cluster is not null").groupBy("cluster").agg(F.count("*").alias("n"), F.min("distance").alias("least"))
    first = lists.select("cluster", "size", F.col("typical")[0].alias("region_id"))
    both = first.join(sizes, "cluster", "full").join(members.select("region_id", "distance"), "region_id", "left")
    right = both.agg(F.coalesce(F.bool_and(F.col("size").eqNullSafe(F.col("n")) & F.col("distance").eqNullSafe(F.col("least"))), F.lit(True)).alias("right"))
    return members.agg(F.count("*").alias("regions"), F.countDistinct("region_id").alias("different")).join(right)


# Problem 2


def _measured(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """(group, more, metric, value): the valid values, one row each."""
    regions = _current_regions(spark, d, *GROUP, *more, "area", "circularity")
    metric = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("area", "circularity"))))
    rows = regions.select(*GROUP, *more, metric.alias("m")).select(*GROUP, *more, "m.*")
    return rows.where(is_number(F.col("value")) & F.when(F.col("metric") == "area", F.col("value") > 0).otherwise(F.col("value") >= 0))


def _first_count(n: Column, share: Column, strict: bool) -> Column:
    """The smallest count whose share of n is above `share` (or at least it), as shares of doubles compare."""
    guess = F.floor(n * share)
    out = guess + 3
    for k in (2, 1, 0, -1, -2):
        candidate = guess + k
        enough = candidate / n > share if strict else candidate / n >= share
        out = F.when(enough, candidate).otherwise(out)
    return out.cast("bigint")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Claims that are wrong. More than q + 0.01 of the values lie below the claim if, and only if, the value with the
    first rank whose share is above that lies below it; likewise on the other side. Both ranks are selected exactly."""
    scratch = Scratch(spark, "p2")
    keys = [*GROUP, "metric"]
    values = scratch.save(_measured(spark, d).withColumn("value", ordered_bits(F.col("value"))), "values")
    histogram = scratch.save(radix_histogram(values, keys, "value", DIGIT, ordered=True), "histogram")
    totals = histogram.groupBy(*keys).agg(F.sum("n").alias("total"))
    claims = _table(spark, d, "reported_percentiles").withColumn("stack_name", stack_key(F.col("stack_name"))).join(totals, keys)
    claims = claims.withColumn("high_rank", _first_count(F.col("total"), F.col("quantile_p") + 0.01, True)).withColumn("low_rank", _first_count(F.col("total"), F.col("quantile_p") - 0.01, False))
    claims = scratch.save(claims, "claims")
    sides = claims.select("claim_id", "claimed_value", *keys, F.explode(F.array(F.struct(F.lit(True).alias("high"), F.col("high_rank").alias("rank")), F.struct(F.lit(False).alias("high"), F.col("low_rank").alias("rank")))).alias("s")).select("claim_id", "claimed_value", *keys, "s.*")
    selected = select_ranks(values, keys, "value", sides, histogram=histogram, ordered=True, scratch=scratch)
    wrong = sides.join(selected, [*keys, "rank"]).where(F.when(F.col("high"), F.col("value") < F.col("claimed_value")).otherwise(F.col("value") > F.col("claimed_value")))
    return wrong.select("claim_id").distinct()


QUANTILES = [0.05, 0.25, 0.5, 0.75, 0.95]


def p2_exact(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of every image, scene and stack, exact: the values with the ranks ceil(q * n)."""
    scratch = Scratch(spark, "p2")
    keys = [*GROUP, "metric"]
    values = scratch.save(_measured(spark, d).withColumn("value", ordered_bits(F.col("value"))), "values")
    histogram = scratch.save(radix_histogram(values, keys, "value", DIGIT, ordered=True), "histogram")
    wanted = F.explode(F.array(*map(F.lit, QUANTILES))).alias("quantile_p")
    targets = histogram.groupBy(*keys).agg(F.sum("n").alias("total")).select(*keys, "total", wanted).withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("quantile_p") * F.col("total"))))
    selected = select_ranks(values, keys, "value", targets, histogram=histogram, ordered=True, scratch=scratch)
    return targets.join(selected, [*keys, "rank"]).select(*keys, "quantile_p", F.col("total").alias("n"), "value")


#: Leading bits of a merged histogram: relative error at most 2 ** (12 - 22), 0.1 %.
MERGED_BITS = 22


def p2_merged(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles with an error bound, from histograms of single slices added up."""
    keys = [*GROUP, "metric"]
    by_slice = radix_histogram(_measured(spark, d, "t", "z"), [*keys, "t", "z"], "value", MERGED_BITS)
    return histogram_percentiles(merge_histograms([by_slice], keys), keys, QUANTILES, MERGED_BITS)


def p2_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Whether the exact percentiles lie within the bounds of the merged histograms."""
    exact = p2_exact(spark, d)
    merged = p2_merged(spark, d).select(*GROUP, "metric", F.col("quantile").alias("quantile_p"), "lower", "upper")
    within = F.col("value").between(F.col("lower"), F.col("upper"))
    return exact.join(merged, [*GROUP, "metric", "quantile_p"], "left").select(*GROUP, "metric", "quantile_p", "n", F.coalesce(within, F.lit(False)).alias("within"))


# Problem 3


def _links(spark: SparkSession, d: str) -> DataFrame:
    """(region_id_a, region_id_b): the regions that a pair above its threshold names."""
    pairs = _table(spark, d, "region_pairs").select("pair_id", "ingested_at", *SLICE, "stack1_name", "region1_label", "stack2_name", "region2_label", "above_threshold")
    pairs = current_rows(pairs, "pair_id", "ingested_at").where("above_threshold and region1_label > 0 and region2_label > 0")
    names = _current_regions(spark, d, *SLICE, "stack_name", "label").groupBy(*SLICE, "stack_name", "label").agg(F.min("region_id").alias("region_id"))
    for side, letter in (("1", "a"), ("2", "b")):
        pairs = pairs.withColumn("stack_name", stack_key(F.col(f"stack{side}_name"))).withColumn("label", F.col(f"region{side}_label")).join(names.withColumnRenamed("region_id", f"region_id_{letter}"), [*SLICE, "stack_name", "label"]).drop("stack_name", "label")
    return pairs.select("region_id_a", "region_id_b")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    groups = link_groups(_links(spark, d), "region_id_a", "region_id_b")
    return groups.select(F.col("node").alias("region_id"), F.col("group").alias("group_id"))


def p3_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Each group of linked regions with its number of members and of slices."""
    return p3_found(spark, d).groupBy("group_id").agg(F.count("*").alias("members"), F.max("region_id").alias("last_region_id"))


# Problem 4


def p4_top3(spark: SparkSession, d: str) -> DataFrame:
    """The best three pairs of every first region, with their places."""
    columns = [*SLICE, "stack1_name", "region1_label"]
    pairs = _table(spark, d, "region_pairs").select("pair_id", "ingested_at", *columns, "region2_label", "overlap_score")
    pairs = current_rows(pairs, "pair_id", "ingested_at").drop("ingested_at").where("region1_label > 0 and region2_label > 0").where(is_number(F.col("overlap_score")) & F.col("overlap_score").between(0, 1))
    pairs = pairs.withColumn("stack1_name", stack_key(F.col("stack1_name")))
    return top_n(pairs, columns, [F.col("overlap_score").desc(), F.col("region2_label"), F.col("pair_id")], 3, rank="place", unique=True)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_top3(spark, d).select("pair_id")


# Problem 6

CONTAINER_TOKENS = 4096


def _sizes(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return with_token_counts(_table(spark, d, "documents"), "text", "size", keep=["doc_id", *columns])


def p6_packing(spark: SparkSession, d: str) -> DataFrame:
    """Every mail, or piece of one that is longer than a container, with its container."""
    return pack_documents(_sizes(spark, d), CONTAINER_TOKENS)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Mails that the finished packing has in several pieces."""
    return p6_packing(spark, d).where("pieces > 1").select("doc_id").distinct()


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are: each one's tokens and items."""
    return p6_packing(spark, d).groupBy("container").agg(F.sum("size").alias("tokens"), F.count("*").alias("items"))


def p6_checks(spark: SparkSession, d: str) -> DataFrame:
    """Of each mail whether all its tokens are packed, split only beyond a container, in containers none of which is too full."""
    scratch = Scratch(spark, "p6")
    sizes = scratch.save(_sizes(spark, d), "sizes")
    packed = scratch.save(pack_documents(sizes, CONTAINER_TOKENS, scratch=scratch), "packed")
    fills = packed.groupBy("container").agg((F.sum("size") <= CONTAINER_TOKENS).alias("fits"))
    per = packed.join(fills, "container").groupBy("doc_id").agg(F.sum("size").alias("packed"), F.count("*").alias("n"), F.countDistinct("piece").alias("different"), F.bool_and("fits").alias("fits"))
    fewest = F.greatest(F.lit(1), F.ceil(F.col("size") / CONTAINER_TOKENS))
    whole = (F.col("packed") == F.col("size")) & (F.col("n") == fewest) & (F.col("n") == F.col("different"))
    return sizes.join(per, "doc_id", "left").select("doc_id", F.coalesce(whole, F.lit(False)).alias("whole"), F.coalesce("fits", F.lit(False)).alias("fits"))


# Problem 7


def _mixed(spark: SparkSession, d: str, **options: bool) -> tuple[DataFrame, DataFrame]:
    return mix(_sizes(spark, d, "source"), _table(spark, d, "mix_targets"), **options)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that give too little though the sampler has used each of their documents as often as it may be."""
    return _mixed(spark, d)[1].where("short").select("source")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """What each source has, should give and gives."""
    return _mixed(spark, d)[1]


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mails that are used and how often."""
    return _mixed(spark, d)[0]


def p7_rescaled(spark: SparkSession, d: str) -> DataFrame:
    """The report of the largest mixture that has the target shares."""
    return _mixed(spark, d, rescale=True)[1]


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """Of each source whether the mixture keeps its cap, adds up to the report, and gives what is wanted within 5 %, unless short."""
    copies, report = _mixed(spark, d)
    sums = copies.groupBy("source").agg(F.max("copies").alias("most"), F.sum(F.col("copies") * F.col("size")).alias("tokens"), F.countDistinct("doc_id").alias("used"))
    rows = report.join(sums, "source", "left")
    capped = F.coalesce(F.col("most") <= F.col("max_repeats"), F.lit(True)) & (F.col("used_documents") <= F.col("documents"))
    agree = (F.coalesce("tokens", F.lit(0)) == F.col("reached")) & (F.coalesce("used", F.lit(0)) == F.col("used_documents"))
    near = F.col("short") | (F.abs(F.col("reached") - F.col("wanted")) <= 0.05 * F.col("wanted"))
    return rows.select("source", "target_share", F.col("max_repeats").cast("int").alias("max_repeats"), "documents", capped.alias("capped"), agree.alias("agree"), near.alias("near"))


# Problem 8


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Words, repeated words and their share of every mail."""
    return repetition_shares(_table(spark, d, "documents"), "text", ["doc_id", "lang", "source"]).select("doc_id", "words", "repeated")


def p8_adaptive(spark: SparkSession, d: str) -> DataFrame:
    """Mails whose share is unusual for their language and source."""
    shares = repetition_shares(_table(spark, d, "documents"), "text", ["doc_id", "lang", "source"])
    return repetitive(shares, "lang", "source").select("doc_id", "share", "threshold")


def p8_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """The threshold of each language and source: whether its rank among the group's shares is within the sketch's error."""
    shares = repetition_shares(_table(spark, d, "documents"), "text", ["doc_id", "lang", "source"])
    scratch = Scratch(spark, "p8")
    by = {"language": F.lower(F.trim(F.coalesce("lang", F.lit("")))), "source_name": F.coalesce("source", F.lit(""))}
    keyed = scratch.save(shares.select("share", *(c.alias(k) for k, c in by.items())), "shares")
    limits = scratch.save(adaptive_thresholds(share_sketches(keyed, list(by)), list(by), 0.99, 0.0, 1.0), "limits")
    counted = keyed.join(limits, list(by)).groupBy(*by).agg(F.count("*").alias("documents"), F.avg((F.col("share") < F.col("threshold")).cast("double")).alias("below"), F.avg((F.col("share") <= F.col("threshold")).cast("double")).alias("upto"))
    within = (F.col("below") <= 0.99 + rank_error()) & (F.col("upto") >= 0.99 - rank_error())
    return counted.select(*by, "documents", within.alias("within"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Mails above a third: by the thresholds that their group's sketch has around it, and in between by exact counts."""
    shares = repetition_shares(_table(spark, d, "documents"), "text", ["doc_id", "lang", "source"])
    return above_level(shares, "lang", "source", 1 / 3, F.expr("3 * repeated > words")).select("doc_id")


QUERIES = {
    "p1_found": p1_found,
    "p1_clusters": p1_clusters,
    "p1_members": p1_members,
    "p1_checks": p1_checks,
    "p2_found": p2_found,
    "p2_exact": p2_exact,
    "p2_merged": p2_merged,
    "p2_bounds": p2_bounds,
    "p3_found": p3_found,
    "p3_group_sizes": p3_group_sizes,
    "p4_found": p4_found,
    "p4_top3": p4_top3,
    "p6_found": p6_found,
    "p6_packing": p6_packing,
    "p6_fill": p6_fill,
    "p6_checks": p6_checks,
    "p7_found": p7_found,
    "p7_report": p7_report,
    "p7_mixture": p7_mixture,
    "p7_rescaled": p7_rescaled,
    "p7_checks": p7_checks,
    "p8_found": p8_found,
    "p8_shares": p8_shares,
    "p8_adaptive": p8_adaptive,
    "p8_thresholds": p8_thresholds,
}
