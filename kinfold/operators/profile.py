"""Profiles and diagnostics of records, gold and features: each a handful of aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions import text as T


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def matches_per_s1(s1: DataFrame, gold: DataFrame) -> DataFrame:
    """(n_matches, n): how many S1 records have how many matches; 0 for singletons."""
    per = gold.groupBy("s1_id").agg(F.count("*").alias("n_matches"))
    e = s1.select(F.col("eid").alias("s1_id")).join(per, "s1_id", "left").fillna(0, ["n_matches"])
    return histogram(e, "n_matches")


def match_composition(gold: DataFrame) -> DataFrame:
    """(has_s2, has_s3, n) over S1 records with matches."""
    per = gold.groupBy("s1_id").agg(F.bool_or(F.col("s2_id").startswith("S2-")).alias("has_s2"), F.bool_or(F.col("s2_id").startswith("S3-")).alias("has_s3"))
    return per.groupBy("has_s2", "has_s3").agg(F.count("*").alias("n"))


def duplicate_ids(records: DataFrame) -> DataFrame:
    return records.groupBy("eid").agg(F.count("*").alias("n")).where("n > 1")


def missing_ids(gold: DataFrame, records: DataFrame) -> DataFrame:
    """Counts of gold S1 ids with and without a record."""
    ids = gold.select(F.col("s1_id").alias("eid")).distinct().join(records.select("eid").distinct().withColumn("hit", F.lit(1)), "eid", "left")
    return ids.agg(F.count("hit").alias("n_present"), F.count_if(F.col("hit").isNull()).alias("n_missing"))


def ambiguous_matches(gold: DataFrame) -> DataFrame:
    """S2 or S3 ids that match several S1 records."""
    return gold.groupBy("s2_id").agg(F.count_distinct("s1_id").alias("n_s1")).where("n_s1 > 1")


def field_counts(records: DataFrame, field: str) -> DataFrame:
    """By source: rows, blank values, values with a digit, values with an Indic letter, domain-like values."""
    c = F.coalesce(F.col(field), F.lit(""))
    return records.groupBy("src").agg(
        F.count("*").alias("n"), F.count_if(F.trim(c) == "").alias("n_blank"), F.count_if(c.rlike("[0-9]")).alias("n_digit"),
        F.count_if(c.rlike(T.INDIC)).alias("n_indic"), F.count_if(F.lower(c).rlike(r"\w+\.(com|net|org|in|co)\b")).alias("n_domain"),
    )


def script_counts(records: DataFrame, field: str) -> DataFrame:
    """(script, n): records by each script beyond ASCII in a field."""
    return records.select(F.explode(T.script_profile(F.coalesce(F.col(field), F.lit("")))).alias("script")).groupBy("script").agg(F.count("*").alias("n"))


def script_classes(records: DataFrame, field: str) -> DataFrame:
    return records.groupBy("src", T.script_class(F.coalesce(F.col(field), F.lit(""))).alias("script_class")).agg(F.count("*").alias("n"))


def vocabulary_size(records: DataFrame, column: str = "name_toks", approximate: bool = False) -> DataFrame:
    words = records.select(F.explode(column).alias("w"))
    return words.agg((F.approx_count_distinct("w") if approximate else F.count_distinct("w")).alias("n_words"))


def surplus_duplicates(records: DataFrame, *columns: str) -> DataFrame:
    """How many records could go if those equal in the columns became one."""
    return records.groupBy(*columns).agg(F.count("*").alias("c")).agg(F.sum(F.col("c") - 1).alias("n_surplus"), F.count("*").alias("n_distinct"))


def agreement(gold: DataFrame, records: DataFrame) -> DataFrame:
    """Gold pairs, those equal in normalised name, in address, and across countries."""
    side = lambda k: records.select(F.col("eid").alias(f"{k}_id"), F.struct("name", "addr", "country").alias(k))
    g = gold.join(side("s1"), "s1_id").join(side("s2"), "s2_id")
    return g.agg(F.count("*").alias("n_pairs"), F.count_if(F.expr("s1.name = s2.name")).alias("n_same_name"), F.count_if(F.expr("s1.addr = s2.addr")).alias("n_same_addr"), F.count_if(F.expr("s1.country <> s2.country")).alias("n_cross_country"))


def length_quantiles(records: DataFrame, field: str) -> DataFrame:
    """Nearest-rank length percentiles: the value at place floor(n * q) from 0. Counts by length come first, and there are few lengths."""
    by = records.select(F.length(F.coalesce(F.col(field), F.lit(""))).alias("len")).groupBy("len").agg(F.count("*").alias("c"))
    packed = by.agg(F.array_sort(F.collect_list(F.struct("len", "c"))).alias("x"), F.sum("c").alias("n"), F.max("len").alias("max_len"))
    place = lambda q: F.aggregate("x", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("at")), lambda s, v: F.struct((s["seen"] + v["c"]).alias("seen"), F.when(s["at"].isNull() & (s["seen"] + v["c"] > F.floor(F.col("n") * q)), v["len"]).otherwise(s["at"]).alias("at")), lambda s: s["at"])
    return packed.select(place(0.5).alias("p50"), place(0.9).alias("p90"), place(0.99).alias("p99"), "max_len")


def key_hit_counts(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """(key_id, n): gold pairs found by each key, and by any under -1; all gold pairs under -2."""
    per = hits.groupBy("key_id").agg(F.count("*").alias("n"))
    any_key = hits.select("s1_id", "s2_id").distinct().agg(F.lit(-1).alias("key_id"), F.count("*").alias("n"))
    return per.unionByName(any_key).unionByName(gold.agg(F.lit(-2).alias("key_id"), F.count("*").alias("n")))


def caught_by_new_keys(hits: DataFrame, gold: DataFrame, old: tuple[int, ...], new: tuple[int, ...]) -> DataFrame:
    """Of the gold pairs that no old key finds: how many each new key finds, and how many stay unfound."""
    flags = hits.groupBy("s1_id", "s2_id").agg(F.bool_or(F.col("key_id").isin(*old)).alias("old"), *[F.bool_or(F.col("key_id") == k).alias(f"k{k}") for k in new])
    missed = gold.select("s1_id", "s2_id").distinct().join(flags, ["s1_id", "s2_id"], "left").where(~F.coalesce("old", F.lit(False)))
    got = [F.count_if(F.coalesce(f"k{k}", F.lit(False))).alias(f"by_k{k}") for k in new]
    found = F.lit(False)
    for k in new:
        found = found | F.coalesce(F.col(f"k{k}"), F.lit(False))
    return missed.agg(F.count("*").alias("n_missed"), *got, F.count_if(~found).alias("n_still_missed"))


def missed_shared_frequency(hits: DataFrame, gold: DataFrame, records: DataFrame, frequency: DataFrame) -> DataFrame:
    """Percentiles of the lowest frequency among name words that both records of a missed gold pair have."""
    missed = gold.join(hits.select("s1_id", "s2_id").distinct(), ["s1_id", "s2_id"], "left_anti")
    side = lambda k: records.select(F.col("eid").alias(f"{k}_id"), F.col("name_toks").alias(k))
    shared = missed.join(side("s1"), "s1_id").join(side("s2"), "s2_id").select("s1_id", "s2_id", F.explode(F.array_intersect("s1", "s2")).alias("term")).join(frequency, "term")
    low = shared.groupBy("s1_id", "s2_id").agg(F.min("df").alias("df"))
    return low.agg(F.count("*").alias("n_pairs"), *[F.percentile("df", F.lit(q)).alias(f"p{round(q * 100)}") for q in (0.1, 0.5, 0.9)])


def feature_summary(labelled: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(feature, mean, p10, p90, pos_mean, neg_mean): features unpivoted, one aggregation."""
    long = labelled.unpivot(["label"], list(names), "feature", "value")
    q = lambda p: F.percentile("value", F.lit(p))
    return long.groupBy("feature").agg(F.avg("value").alias("mean"), q(0.1).alias("p10"), q(0.9).alias("p90"), F.avg(F.when(F.col("label") == 1, F.col("value"))).alias("pos_mean"), F.avg(F.when(F.col("label") == 0, F.col("value"))).alias("neg_mean"))


def coverage(records: DataFrame, column: str = "pin") -> DataFrame:
    """Share of known values by source and country, with totals (null country) by source."""
    known = F.when(F.col(column).isNotNull(), 1.0).otherwise(0.0)
    return records.rollup("src", "country").agg(F.count("*").alias("n"), F.avg(known).alias("coverage")).where("src is not null")
