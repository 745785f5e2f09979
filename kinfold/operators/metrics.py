"""Labels, holdout, and quality of candidates and matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def holdout(eid: Column, fraction: float = 0.25, seed: int = 1234567) -> Column:
    """A fixed share of ids, by a hash that every engine has."""
    code = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), eid).cast("binary")), 1, 8), 16, 10).cast("long")
    return F.pmod(code, F.lit(10_000)) < int(fraction * 10_000)


def label_pairs(pairs: DataFrame, gold: DataFrame) -> DataFrame:
    """pairs with label (1 for gold) and is_val, both without a lookup on the driver."""
    g = gold.select("s1_id", "s2_id").distinct().withColumn("_g", F.lit(1.0))
    return pairs.join(g, ["s1_id", "s2_id"], "left").withColumn("label", F.coalesce("_g", F.lit(0.0))).withColumn("is_val", holdout(F.col("s1_id"))).drop("_g")


def f05(precision: Column, recall: Column) -> Column:
    den = 0.25 * precision + recall
    return F.when(den > 0, 1.25 * precision * recall / den).otherwise(0.0)


def entity_scores(s1: DataFrame, kept: DataFrame, gold: DataFrame, singleton_score: float | None = None) -> DataFrame:
    """(s1_id, n_gold, n_kept, tp, f05) for every S1 id of s1(eid); kept and gold are (s1_id, s2_id).

    Nothing kept counts as precision 1, no gold as recall 1: a singleton left alone scores 1 and one with a match 0.
    singleton_score gives all singletons another score.
    """
    g = gold.select("s1_id", "s2_id").distinct()
    n_gold = g.groupBy("s1_id").agg(F.count("*").alias("n_gold"))
    k = kept.select("s1_id", "s2_id").distinct().join(g.withColumn("hit", F.lit(1)), ["s1_id", "s2_id"], "left")
    n_kept = k.groupBy("s1_id").agg(F.count("*").alias("n_kept"), F.count("hit").alias("tp"))
    e = s1.select(F.col("eid").alias("s1_id")).join(n_gold, "s1_id", "left").join(n_kept, "s1_id", "left").fillna(0, ["n_gold", "n_kept", "tp"])
    p = F.when(F.col("n_kept") > 0, F.col("tp") / F.col("n_kept")).otherwise(1.0)
    r = F.when(F.col("n_gold") > 0, F.col("tp") / F.col("n_gold")).otherwise(1.0)
    score = f05(p, r)
    if singleton_score is not None:
        score = F.when(F.col("n_gold") == 0, F.lit(float(singleton_score))).otherwise(score)
    return e.withColumn("f05", score)


def macro_f05(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("f05").alias("macro_f05"), F.count("*").alias("n_entities"), F.sum("tp").alias("tp"), F.sum("n_kept").alias("n_kept"), F.sum("n_gold").alias("n_gold"))


def worst_entities(scores: DataFrame, n: int = 15) -> DataFrame:
    return scores.orderBy("f05", "s1_id").limit(n)


def candidate_stats(s1: DataFrame, pairs: DataFrame) -> DataFrame:
    """Distribution of candidates per S1 record, those without any included."""
    n = pairs.groupBy("s1_id").agg(F.count("*").alias("n"))
    c = s1.select(F.col("eid").alias("s1_id")).join(n, "s1_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    q = lambda p: F.percentile("n", F.lit(p))
    return c.agg(F.sum("n").cast("long").alias("n_pairs"), F.avg("n").alias("mean_n"), q(0.5).alias("p50"), q(0.9).alias("p90"), q(0.99).alias("p99"), F.max("n").cast("long").alias("max_n"))


def recall_report(s1: DataFrame, pairs: DataFrame, gold: DataFrame) -> DataFrame:
    """Pair recall, macro recall (S1 records with gold only) and the share of S1 records whose gold is all found; a
    record without gold counts as full."""
    g = gold.select("s1_id", "s2_id").distinct().join(pairs.select("s1_id", "s2_id").distinct().withColumn("hit", F.lit(1)), ["s1_id", "s2_id"], "left")
    per = g.groupBy("s1_id").agg(F.count("*").alias("n"), F.count("hit").alias("found"))
    e = s1.select(F.col("eid").alias("s1_id")).join(per, "s1_id", "left")
    return e.agg(
        (F.sum("found") / F.sum("n")).alias("pair_recall"), F.avg(F.col("found") / F.col("n")).alias("macro_recall"),
        F.avg(F.when(F.col("n").isNull() | (F.col("found") == F.col("n")), 1.0).otherwise(0.0)).alias("full_recall"),
    )


def best_partner(scored: DataFrame) -> DataFrame:
    """For each S2 or S3 record its likeliest S1 record; of equals the one that sorts first. Spark cuts each group to its
    first row before the shuffle."""
    w = Window.partitionBy("s2_id").orderBy(F.desc("p"), "s1_id")
    return scored.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def resolve(scored: DataFrame, tau: float, one_to_one: bool = True) -> DataFrame:
    """Pairs with p >= tau; one to one, each S2 or S3 record goes to its likeliest S1 record. Empty if none passes."""
    kept = scored.where(F.col("p") >= tau)
    return best_partner(kept) if one_to_one else kept


def thresholds(low: float = 0.20, high: float = 0.99, step: float = 0.01) -> list[float]:
    n = int(round((high - low) / step)) + 1
    return [round(low + k * step, 10) for k in range(n)]


def threshold_sweep(s1: DataFrame, scored: DataFrame, gold: DataFrame, taus: list[float] | None = None) -> DataFrame:
    """(mode, tau, macro_f05) for every threshold in both modes, in one pass.

    An S2 record's winner doesn't depend on tau, so it is found once. Each pair then counts for all taus up to its p:
    pairs become (s1_id, bucket) counts, and an entity's counts at each tau are running sums over at most as many buckets as
    there are taus. Entities without a pair at some tau all score alike there, and are added by count.
    """
    taus = taus or thresholds()
    t = F.array(*[F.lit(x) for x in taus])
    g = gold.select("s1_id", "s2_id").distinct()
    hit = scored.join(g.withColumn("hit", F.lit(1)), ["s1_id", "s2_id"], "left")
    best = best_partner(hit)
    both = hit.withColumn("mode", F.lit("plain")).unionByName(best.withColumn("mode", F.lit("one_to_one")))
    bucket = F.size(F.filter(t, lambda x: x <= F.col("p")))  # passes the first so many taus
    counts = both.withColumn("bucket", bucket).where("bucket > 0").groupBy("mode", "s1_id", "bucket").agg(F.count("*").alias("k"), F.count("hit").alias("h"))
    n_gold = g.groupBy("s1_id").agg(F.count("*").alias("n_gold"))
    packed = counts.groupBy("mode", "s1_id").agg(F.collect_list(F.struct("bucket", "k", "h")).alias("b"))  # no more than there are taus
    entities = s1.select(F.col("eid").alias("s1_id")).join(n_gold, "s1_id", "left").fillna(0, ["n_gold"])
    modes = entities.select("*", F.explode(F.array(F.lit("plain"), F.lit("one_to_one"))).alias("mode"))
    e = modes.join(packed, ["mode", "s1_id"], "left").select("mode", "n_gold", F.coalesce("b", F.array().cast("array<struct<bucket:int,k:long,h:long>>")).alias("b"), F.posexplode(t).alias("i", "tau"))
    total = lambda f: F.aggregate(F.filter("b", lambda x: x["bucket"] > F.col("i")), F.lit(0).cast("long"), lambda s, x: s + x[f])
    e = e.withColumn("n_kept", total("k")).withColumn("tp", total("h"))
    p = F.when(F.col("n_kept") > 0, F.col("tp") / F.col("n_kept")).otherwise(1.0)
    r = F.when(F.col("n_gold") > 0, F.col("tp") / F.col("n_gold")).otherwise(1.0)
    return e.groupBy("mode", "tau").agg(F.avg(f05(p, r)).alias("macro_f05"))


def best_setting(sweep: DataFrame) -> DataFrame:
    """The highest score; of equals the lowest tau, plain before one-to-one."""
    return sweep.orderBy(F.desc("macro_f05"), "tau", F.when(F.col("mode") == "plain", 0).otherwise(1)).limit(1)


def average_precision(scored: DataFrame, p: str = "p", label: str = "label") -> DataFrame:
    """Average precision over distinct scores: equal scores enter together. Counts by score come first, and running sums go over those in a
    two-level scan (ranges of scores, then scores), so no task sees all rows."""
    by = scored.groupBy(p).agg(F.count("*").alias("n"), F.sum(label).alias("y")).repartitionByRange(F.desc(p)).sortWithinPartitions(F.desc(p)).withColumn("part", F.spark_partition_id())
    sums = by.groupBy("part").agg(F.sum("n").alias("n0"), F.sum("y").alias("y0"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = sums.select("part", F.coalesce(F.sum("n0").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("y0").over(before), F.lit(0.0)).alias("y0"))
    w = Window.partitionBy("part").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    run = by.select("part", "y", F.sum("n").over(w).alias("cn"), F.sum("y").over(w).alias("cy")).join(F.broadcast(offsets), "part")
    precision = (F.col("cy") + F.col("y0")) / (F.col("cn") + F.col("n0"))
    return run.agg(F.when(F.sum("y") > 0, F.sum(precision * F.col("y")) / F.sum("y")).otherwise(0.0).alias("average_precision"))
