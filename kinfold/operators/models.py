"""Sampling, learners, blending and stacking over labelled pairs.  Scores come back as a column, not to the driver."""

from __future__ import annotations

import random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators.features import DROPPED, FEATURES
from kinfold.operators.metrics import average_precision, best_setting, threshold_sweep

KEPT = tuple(x for x in FEATURES if x not in DROPPED)
#: What configurations are drawn from; the grower is Spark's, so leaves become depth.
GRID = {"ratio": [1.5, 2.0, 3.0, 4.0], "maxDepth": [5, 6, 7, 8], "stepSize": [0.05, 0.08, 0.1], "minInstancesPerNode": [10, 30, 80], "subsamplingRate": [0.7, 0.85, 1.0]}


def sample_negatives(pairs: DataFrame, ratio: float, seed: int = 42) -> DataFrame:
    """All positives and about ratio times as many negatives: those whose hash falls under the share wanted, so that no sort is needed and
    the choice doesn't depend on partitions. A sampling operator."""
    n = pairs.agg(F.count_if(F.expr("label = 1")).alias("p"), F.count_if(F.expr("label = 0")).alias("n")).first()
    share = min(1.0, ratio * n["p"] / n["n"]) if n["n"] else 1.0
    h = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "s1_id", F.lit(":"), "s2_id").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(1_000_000))
    return pairs.where((F.col("label") == 1) | (h < int(share * 1_000_000)))


def standardize(pairs: DataFrame, names: tuple[str, ...], fitted_on: DataFrame | None = None) -> DataFrame:
    """Columns less their mean over their population deviation (1 where that is under 1e-8)."""
    s = (fitted_on if fitted_on is not None else pairs).agg(*[F.avg(c).alias(f"m_{c}") for c in names], *[F.stddev_pop(c).alias(f"s_{c}") for c in names]).first()
    sd = {c: s[f"s_{c}"] if (s[f"s_{c}"] or 0) >= 1e-8 else 1.0 for c in names}
    return pairs.withColumns({c: (F.col(c) - (s[f"m_{c}"] or 0.0)) / sd[c] for c in names})


def fit_gbt(train: DataFrame, names: tuple[str, ...] = KEPT, iterations: int = 40, **params) -> PipelineModel:
    params = {k: v for k, v in params.items() if k != "ratio"}
    gbt = GBTClassifier(labelCol="label", featuresCol="_features", maxIter=iterations, seed=7, **({"maxDepth": 5} | params))
    return Pipeline(stages=[VectorAssembler(inputCols=list(names), outputCol="_features", handleInvalid="keep"), gbt]).fit(train)


def score_gbt(model: PipelineModel, pairs: DataFrame, out: str = "p") -> DataFrame:
    return model.transform(pairs).withColumn(out, vector_to_array("probability")[1]).drop("_features", "rawPrediction", "probability", "prediction")


def fit_logistic(train: DataFrame, names: tuple[str, ...] = KEPT, l2: float = 0.0, iterations: int = 25) -> PipelineModel:
    """Iteratively reweighted least squares; unpenalised unless l2 is given."""
    glr = GeneralizedLinearRegression(family="binomial", link="logit", labelCol="label", featuresCol="_features", maxIter=iterations, regParam=l2, predictionCol="p_raw")
    return Pipeline(stages=[VectorAssembler(inputCols=list(names), outputCol="_features", handleInvalid="keep"), glr]).fit(train)


def score_logistic(model: PipelineModel, pairs: DataFrame, out: str = "p") -> DataFrame:
    return model.transform(pairs).withColumn(out, F.col("p_raw")).drop("_features", "p_raw")


def blend(pairs: DataFrame, columns: tuple[str, ...] = ("p_gbt", "p_lr"), out: str = "p") -> DataFrame:
    total = F.lit(0.0)
    for c in columns:
        total = total + F.col(c)
    return pairs.withColumn(out, total / len(columns))


def fold(folds: int = 5):
    """Folds by S1 id: an entity's pairs stay together."""
    return F.pmod(F.xxhash64("s1_id"), F.lit(folds))


def stack(pairs: DataFrame, columns: tuple[str, ...] = ("p_gbt", "p_lr"), folds: int = 5, l2: float = 1e-3, out: str = "p") -> DataFrame:
    """Out-of-fold probabilities of a logistic model over other models' probabilities."""
    marked = pairs.withColumn("_fold", fold(folds))
    parts = None
    for k in range(folds):
        model = fit_logistic(marked.where(F.col("_fold") != k), columns, l2)
        part = score_logistic(model, marked.where(F.col("_fold") == k), out)
        parts = part if parts is None else parts.unionByName(part)
    return parts.drop("_fold")


def sample_configs(n: int, seed: int = 7) -> list[dict]:
    """n distinct random configurations of GRID."""
    rng = random.Random(seed)
    out: list[dict] = []
    total = 1
    for v in GRID.values():
        total *= len(v)
    while len(out) < min(n, total):
        c = {k: rng.choice(v) for k, v in GRID.items()}
        if c not in out:
            out.append(c)
    return out


def search(labelled: DataFrame, configs: list[dict], names: tuple[str, ...] = KEPT, iterations: int = 40, done: dict | None = None) -> tuple[PipelineModel, dict, list[tuple[dict, float]]]:
    """The model of the configuration with the highest average precision on the holdout, that configuration, and all results;
    done maps configurations (as sorted tuples) to models and scores of an earlier search. A configuration that fails scores 0."""
    train, val = labelled.where("not is_val"), labelled.where("is_val")
    results, best = [], None
    for c in configs:
        known = (done or {}).get(tuple(sorted(c.items())))
        try:
            model, ap = known or ((m := fit_gbt(sample_negatives(train, c["ratio"]), names, iterations, **c)), average_precision(score_gbt(m, val)).first()[0])
        except Exception:  # noqa: BLE001  one configuration may not fit into memory
            model, ap = None, 0.0
        results.append((c, ap))
        if model is not None and (best is None or ap > best[2]):
            best = model, c, ap
    if best is None:
        raise ValueError("no configuration could be fitted")
    return best[0], best[1], results


def choose_variant(variants: dict[str, DataFrame], s1: DataFrame, gold: DataFrame) -> dict:
    """The variant, mode and tau with the highest macro F0.5; scored variants by name."""
    best = None
    for name, scored in variants.items():
        r = best_setting(threshold_sweep(s1, scored, gold)).first()
        if best is None or r["macro_f05"] > best["macro_f05"]:
            best = r.asDict() | {"variant": name}
    return best


def feature_importance(model: PipelineModel, names: tuple[str, ...] = KEPT) -> list[tuple[str, float]]:
    return sorted(zip(names, model.stages[-1].featureImportances.toArray().tolist()), key=lambda x: (-x[1], x[0]))
