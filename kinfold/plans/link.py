"""Whole runs: prepare records, train and choose a model, predict and write both result files, check them.

    python -m kinfold.plans.link train --sources s1.tsv s2.tsv s3.tsv --gold gold.tsv --work DIR
    python -m kinfold.plans.link predict --sources s1.tsv s2.tsv s3.tsv --work DIR --out DIR
    python -m kinfold.plans.link validate --matching FILE --candidates FILE --s1 s1.tsv
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.text import record_text
from kinfold.operators import ann, blocking, features, metrics, models, validate
from kinfold.operators.records import normalize
from kinfold.sources import records as src

#: Learners that may win: trees, logistic, their mean, and a stack of both.
VARIANTS = ("gbt", "logistic", "mean", "stack")


def prepare(spark: SparkSession, sources: list[str], work: str, tag: str) -> DataFrame:
    """Normalised records with frequencies, stored: everything after reads them, and only once from text."""
    raw = src.union_sources(*[src.read_tsv(spark, p) for p in sources])
    return src.write_stage(features.with_frequencies(normalize(raw)), f"{work}/{tag}_records")


def embedding_candidates(records: DataFrame, k: int = 50, cutoff: float | None = 0.5, encoder: ann.Encoder | None = None, k1: int = 1024, k2: int = 64) -> DataFrame:
    """(s1_id, s2_id): each S1 record's nearest S2 and S3 records by text embedding. Ids become numbers for the search by a
    hash of 64 bits, and are joined back."""
    t = records.select("eid", "src", F.xxhash64("eid").alias("id"), record_text(F.col("name"), F.col("addr"), F.col("country")).alias("text"))
    v = (encoder or ann.Encoder().fit_idf(t)).embed(t)
    others = v.where("src > 1")
    index = ann.build_ivf(others, k1, k2)
    probes, _ = ann.choose_probes(v.where("src = 1"), others, index, k, 0.9, cutoff=cutoff)
    found = ann.ivf_join(v.where("src = 1"), others, index, k, probes, cutoff)
    names = t.select("eid", "id")
    return found.join(names.select(F.col("eid").alias("s1_id"), F.col("id").alias("q_id")), "q_id").join(names.withColumnRenamed("eid", "s2_id"), "id").select("s1_id", "s2_id")


def candidates(records: DataFrame, work: str, tag: str, preset: str = "current", embeddings: bool = False) -> DataFrame:
    pairs = blocking.candidate_pairs(records, caps=blocking.CAPS[preset])
    if embeddings:
        pairs = pairs.unionByName(embedding_candidates(records)).distinct()
    return src.write_stage(pairs, f"{work}/{tag}_pairs")


def scored_variants(f: DataFrame, gbt: PipelineModel, logistic: PipelineModel) -> dict[str, DataFrame]:
    both = models.score_logistic(logistic, models.score_gbt(gbt, f, "p_gbt"), "p_lr")
    return {"gbt": both.withColumn("p", F.col("p_gbt")), "logistic": both.withColumn("p", F.col("p_lr")), "mean": models.blend(both)}


def train(spark: SparkSession, sources: list[str], gold_path: str, work: str, trials: int = 4, iterations: int = 40, embeddings: bool = False) -> dict:
    """Fits on three quarters of the S1 records and chooses variant, mode and threshold on the rest; stores models and settings."""
    records = prepare(spark, sources, work, "train")
    gold = src.known_pairs(src.read_gold(spark, gold_path), records)
    pairs = candidates(records, work, "train", embeddings=embeddings)
    f = src.write_stage(metrics.label_pairs(features.features(pairs, records), gold), f"{work}/train_features")
    val, fit = f.where("is_val"), f.where("not is_val")
    gbt, config, results = models.search(f, models.sample_configs(trials), iterations=iterations)
    logistic = models.fit_logistic(models.sample_negatives(fit, 3.0), l2=1e-3)
    variants = {k: src.write_stage(v.select("s1_id", "s2_id", "p_gbt", "p_lr", "label", "p"), f"{work}/val_{k}") for k, v in scored_variants(val, gbt, logistic).items()}
    variants["stack"] = models.stack(variants["mean"].drop("p"), l2=1e-3)
    s1 = records.where("src = 1").select("eid").where(metrics.holdout(F.col("eid")))
    inside = gold.join(s1.withColumnRenamed("eid", "s1_id"), "s1_id", "left_semi")
    best = models.choose_variant({k: v.select("s1_id", "s2_id", "p") for k, v in variants.items()}, s1, inside)
    gbt.write().overwrite().save(f"{work}/gbt")
    logistic.write().overwrite().save(f"{work}/logistic")
    models.fit_logistic(variants["mean"].drop("p"), ("p_gbt", "p_lr"), 1e-3).write().overwrite().save(f"{work}/stack")
    settings = best | {"config": config, "trials": [[c, a] for c, a in results]}
    spark.createDataFrame([(json.dumps(settings),)], "settings string").coalesce(1).write.mode("overwrite").json(f"{work}/settings")
    return best


def predict(spark: SparkSession, sources: list[str], work: str, out: str, embeddings: bool = False) -> None:
    """matching_results and candidate_pairs for new records, with the stored models and settings."""
    settings = json.loads(spark.read.json(f"{work}/settings").first()["settings"])
    records = prepare(spark, sources, work, "test")
    pairs = candidates(records, work, "test", embeddings=embeddings)
    f = features.features(pairs, records)
    scored = scored_variants(f, PipelineModel.load(f"{work}/gbt"), PipelineModel.load(f"{work}/logistic"))
    if settings["variant"] == "stack":
        scored["stack"] = models.score_logistic(PipelineModel.load(f"{work}/stack"), scored["mean"].drop("p"))
    p = scored[settings["variant"]].select("s1_id", "s2_id", "p")
    s1 = records.where("src = 1").select("eid")
    src.write_tsv(src.id_lists(s1, metrics.resolve(p, settings["tau"], settings["mode"] == "one_to_one")), f"{out}/matching_results.tsv")
    src.write_tsv(src.id_lists(s1, pairs, src.CANDIDATE_COLUMNS), f"{out}/candidate_pairs.tsv")


def main(args: list[str] | None = None) -> int:
    a = argparse.ArgumentParser(prog="kinfold.plans.link", description=__doc__)
    sub = a.add_subparsers(dest="command", required=True)
    for name in ("train", "predict"):
        c = sub.add_parser(name)
        c.add_argument("--sources", nargs="+", required=True)
        c.add_argument("--work", required=True)
        c.add_argument("--embeddings", action="store_true")
        c.add_argument("--gold" if name == "train" else "--out", required=True)
    v = sub.add_parser("validate")
    v.add_argument("--matching", required=True)
    v.add_argument("--candidates")
    v.add_argument("--s1", required=True)
    v.add_argument("--ids", nargs="*", help="files of S2 and S3 records, to check ids against")
    o = a.parse_args(args)
    from kinfold.session import session

    spark = session()
    if o.command == "train":
        print(json.dumps(train(spark, o.sources, o.gold, o.work, embeddings=o.embeddings)))
        return 0
    if o.command == "predict":
        predict(spark, o.sources, o.work, o.out, o.embeddings)
        return 0
    ids = None
    for p in o.ids or []:
        more = src.read_ids(spark, p).withColumnRenamed("entity_id", "eid")
        ids = more if ids is None else ids.unionByName(more)
    found = validate.validate(spark, o.matching, src.read_ids(spark, o.s1).withColumnRenamed("entity_id", "eid"), o.candidates, ids)
    found.show(truncate=False)
    return validate.exit_code(found)


if __name__ == "__main__":
    sys.exit(main())
