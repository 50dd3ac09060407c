"""Classifiers with MLlib: fitting, stacking, calibration, scoring, importances, retraining."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.functions.scalars import banded, clip, risk_category_cut
from riskloom.operators import evaluate as E
from riskloom.operators.prep import class_weights, kfold, unit_hash
from riskloom.operators.scan import row_ranks
from riskloom.session import cut_lineage

_c = F.col
Z95 = 1.959963984540054


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    filled = df.withColumns({f: F.coalesce(_c(f).cast("double"), F.lit(0.0)) for f in features})
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(filled)


def fit_logistic(df: DataFrame, y: str = "y", c: float = 1.0, balanced: bool = True, max_iter: int = 1000) -> Model:
    """L2 with strength 1 / (C · n), balanced class weights."""
    n = max(1, df.count())
    est = LogisticRegression(labelCol=y, regParam=1.0 / (c * n), elasticNetParam=0.0, maxIter=max_iter)
    if balanced:
        return est.setWeightCol("weight").fit(class_weights(df, y))
    return est.fit(df)


def fit_forest(df: DataFrame, y: str = "y", trees: int = 300, depth: int = 12, leaf: int = 5, seed: int = 42) -> Model:
    est = RandomForestClassifier(
        labelCol=y, numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, weightCol="weight", seed=seed
    )
    return est.fit(class_weights(df, y))


def fit_boosted(
    df: DataFrame, y: str = "y", rounds: int = 300, depth: int = 5, step: float = 0.05, positive_weight: float = 3.0, seed: int = 42
) -> Model:
    """Gradient-boosted trees; positives weigh more, as in `scale_pos_weight`."""
    weighted = df.withColumn("weight", F.when(_c(y) == 1, positive_weight).otherwise(1.0))
    est = GBTClassifier(
        labelCol=y, maxIter=rounds, maxDepth=depth, stepSize=step, subsamplingRate=0.8, weightCol="weight", seed=seed
    )
    return est.fit(weighted)


def score(model: Model, df: DataFrame, out: str = "p") -> DataFrame:
    """P(default) per row; Spark's partitions are the batches."""
    done = model.transform(df)
    extra = [c for c in done.columns if c not in df.columns]
    return done.withColumn(out, vector_to_array("probability")[1]).drop(*extra)


Fit = Callable[[DataFrame], Model]


def fit_stacking(df: DataFrame, fits: Mapping[str, Fit], key: str, y: str = "y", folds: int = 5) -> tuple[dict[str, Model], Model]:
    """Base models on all rows, and a logistic meta-learner on their out-of-fold scores."""
    folded = cut_lineage(kfold(df, key, folds, y=y))
    parts = []
    for k in range(folds):
        train, held = folded.where(_c("fold") != k), folded.where(_c("fold") == k)
        for name, fit in fits.items():
            held = score(fit(train), held, f"s_{name}")
        parts.append(held.select(key, y, *[f"s_{n}" for n in fits]))
    oof = reduce(DataFrame.unionByName, parts)
    meta = fit_logistic(cut_lineage(assemble(oof, [f"s_{n}" for n in fits])), y, balanced=False)
    return {name: fit(folded) for name, fit in fits.items()}, meta


def score_stacking(models: Mapping[str, Model], meta: Model, df: DataFrame) -> DataFrame:
    out = df
    for name, m in models.items():
        out = score(m, out, f"s_{name}")
    stacked = score(meta, assemble(out.drop("features"), [f"s_{n}" for n in models]), "p")
    return stacked.drop("features")


def _long_scores(df: DataFrame, columns: Mapping[str, str], y: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("model"), _c(c).alias("p")) for n, c in columns.items()])
    return df.select(_c(y).alias("y"), F.explode(pairs).alias("s")).select("y", "s.model", "s.p")


def auc_weights(df: DataFrame, columns: Mapping[str, str], y: str = "y") -> DataFrame:
    """(model, auc_roc, weight): weights in proportion to AUC."""
    auc = E.auc_roc(_long_scores(df, columns, y), by=["model"])
    kept = F.greatest("auc_roc", F.lit(1e-10))
    return auc.withColumn("weight", kept / F.sum(kept).over(Window.partitionBy(F.lit(0))))


def calibrate_isotonic(df: DataFrame, p: str = "p", y: str = "y") -> Model:
    return IsotonicRegression(featuresCol=p, labelCol=y).fit(df.select(_c(p).cast("double"), _c(y).cast("double")))


def train_all(df: DataFrame, valid: DataFrame, fits: Mapping[str, Fit], y: str = "y", by: str = "auc_roc") -> tuple[dict[str, Model], DataFrame, str]:
    """Fit every model, compare them on validation rows in one job, name the best."""
    models = {name: fit(df) for name, fit in fits.items()}
    scored = valid
    for name, m in models.items():
        scored = score(m, scored, f"s_{name}")
    table = cut_lineage(E.all_metrics(_long_scores(scored, {n: f"s_{n}" for n in models}, y), by=["model"]))
    best = table.agg(F.max_by("model", by)).first()[0]
    return models, table, best


def cross_validate(df: DataFrame, fits: Mapping[str, Fit], key: str, y: str = "y", folds: int = 5) -> DataFrame:
    """Mean and population deviation of the fold AUC per model."""
    folded = cut_lineage(kfold(df, key, folds, y=y))
    parts = []
    for k in range(folds):
        train, held = folded.where(_c("fold") != k), folded.where(_c("fold") == k)
        for name, fit in fits.items():
            s = score(fit(train), held)
            parts.append(s.select(F.lit(name).alias("model"), F.lit(k).alias("fold"), _c(y).alias("y"), "p"))
    auc = E.auc_roc(cut_lineage(reduce(DataFrame.unionByName, parts)), by=["model", "fold"])
    return auc.groupBy("model").agg(F.avg("auc_roc").alias("mean_auc"), F.stddev_pop("auc_roc").alias("std_auc"))


def fit_per_group(df: DataFrame, group: str, fit: Fit, least_rows: int = 100, most_groups: int = 1000) -> dict[str, Model]:
    """One distributed fit per group with enough rows. The group list is small by design
    (loan types); more groups than expected is an error, not a silent cut."""
    sizes = df.groupBy(group).count().where(_c("count") >= least_rows).limit(most_groups + 1).collect()
    if len(sizes) > most_groups:
        raise ValueError(f"{group} has more than {most_groups} groups")
    return {r[group]: fit(df.where(_c(group) == r[group])) for r in sizes}


def score_ensemble(df: DataFrame, columns: Mapping[str, str], weights: Mapping[str, float] | None = None) -> DataFrame:
    """Weighted sum, population variance over the models, and risk class."""
    w = weights or {n: 1.0 / len(columns) for n in columns}
    total = reduce(lambda a, b: a + b, [_c(c) * w.get(n, 1.0 / len(columns)) for n, c in columns.items()])
    mean, var = _spread(list(columns.values()))
    out = df.withColumn("ensemble_default_probability", total)
    return out.withColumns(
        {
            "ensemble_risk_score": F.round(_c("ensemble_default_probability") * 100, 2),
            "prediction_variance": var,
            "risk_category": risk_category_cut(_c("ensemble_default_probability")),
            "ensemble_pred": F.when(_c("ensemble_default_probability") >= 0.5, 1).otherwise(0),
        }
    )


def _spread(cols: Sequence[str]) -> tuple[Column, Column]:
    mean = reduce(lambda a, b: a + b, [_c(c) for c in cols]) / len(cols)
    var = reduce(lambda a, b: a + b, [(_c(c) - mean) * (_c(c) - mean) for c in cols]) / len(cols)
    return mean, var


def score_with_interval(df: DataFrame, cols: Sequence[str], z: float = Z95) -> DataFrame:
    """Mean, deviation over the models, clipped interval, confidence 1 - width."""
    mean, var = _spread(cols)
    out = df.withColumns({"mean_proba": mean, "std_proba": F.sqrt(var)})
    out = out.withColumns(
        {
            "ci_lower": clip(_c("mean_proba") - z * _c("std_proba"), 0, 1),
            "ci_upper": clip(_c("mean_proba") + z * _c("std_proba"), 0, 1),
            "prediction": F.when(_c("mean_proba") >= 0.5, 1).otherwise(0),
        }
    )
    return out.withColumn("confidence", 1 - (_c("ci_upper") - _c("ci_lower")))


def fixed_interval(p: Column, half: float = 0.1) -> Column:
    """Serving form: p ± half, inside [0, 1], four decimals."""
    return F.struct(
        F.round(F.greatest(p - half, F.lit(0.0)), 4).alias("lower"), F.round(F.least(p + half, F.lit(1.0)), 4).alias("upper")
    )


def horizon_12m(df: DataFrame, p: str = "p", months: str = "delinquency_months") -> DataFrame:
    factor = F.when(_c(months) > 0, 1 + _c(months) / 12.0 * 0.3).otherwise(F.lit(1.0))
    out = df.withColumn("adjusted_12m_probability", clip(_c(p) * factor, 0, 1))
    a = _c("adjusted_12m_probability")
    return out.withColumns(
        {
            "adjusted_risk_score": F.round(a * 100, 2),
            "estimated_default_horizon": F.when(a > 0.5, "Within 6 months")
            .when(a > 0.25, "Within 12 months")
            .otherwise("Low risk (12+ months)"),
        }
    )


def tree_importance(model: Model, features: Sequence[str], spark: SparkSession) -> DataFrame:
    """(feature, importance): tree importances, or absolute coefficients of a linear model."""
    raw = model.featureImportances if hasattr(model, "featureImportances") else [abs(float(x)) for x in model.coefficients]
    rows = [(f, float(raw[i])) for i, f in enumerate(features)]
    return spark.createDataFrame(rows, "feature string, importance double")


def with_feature(features: Sequence[str], name: str, value: Column) -> Column:
    """Feature vector with one column replaced."""
    return array_to_vector(F.array(*[value if f == name else _c(f).cast("double") for f in features]))


def permutation_importance(model: Model, df: DataFrame, features: Sequence[str], key: str, y: str = "y", seed: int = 42) -> DataFrame:
    """Drop in accuracy when one column is shuffled, for all columns in one scoring job.

    A row takes its shuffled values from the row after it in an order of hashes of the whole
    table, the last row from the first: ranks by slices, then an equi-join on the rank.
    """
    plain = df.select(F.xxhash64(F.lit(seed), _c(key)).alias("__h"), key, y, *features)
    # Kept as a table: both sides of the join must see the same ranks.
    ranked = cut_lineage(row_ranks(plain.withColumn("__tie", F.xxhash64(F.lit(seed + 1), _c(key))), "__h", "__tie", "__rank"))
    n = ranked.count()
    other = ranked.select(
        F.when(_c("__rank") == 1, F.lit(n)).otherwise(_c("__rank") - 1).cast("bigint").alias("__rank"),
        F.struct(*[_c(f).cast("double").alias(f) for f in features]).alias("__other"),
    )
    mixed = ranked.join(other, "__rank")
    variants = [F.struct(F.lit("").alias("feature"), array_to_vector(F.array(*[_c(f).cast("double") for f in features])).alias("features"))]
    variants += [
        F.struct(F.lit(f).alias("feature"), with_feature(features, f, _c(f"__other.{f}")).alias("features")) for f in features
    ]
    rows = mixed.select(y, F.explode(F.array(*variants)).alias("v")).select(y, "v.feature", "v.features")
    hit = F.when((_c("p") >= 0.5) == (_c(y) == 1), 1.0).otherwise(0.0)
    acc = score(model, rows).groupBy("feature").agg(F.avg(hit).alias("accuracy"))
    base = F.max(F.when(_c("feature") == "", _c("accuracy"))).over(Window.partitionBy(F.lit(0)))
    return acc.select("feature", (base - _c("accuracy")).alias("importance")).where(_c("feature") != "")


def partial_dependence(model: Model, df: DataFrame, features: Sequence[str], name: str, grid: Sequence[float]) -> DataFrame:
    """Mean score when one feature is set to each grid value: one job."""
    rows = df.select(*features, F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("grid"))
    rows = rows.select("grid", with_feature(features, name, _c("grid")).alias("features"))
    return score(model, rows).groupBy("grid").agg(F.avg("p").alias("mean_score"))


def tune(df: DataFrame, candidates: Mapping[str, Fit], key: str, y: str = "y", folds: int = 3) -> tuple[str, DataFrame]:
    """Best of named parameter settings by mean fold AUC."""
    table = cut_lineage(cross_validate(df, candidates, key, y, folds))
    return table.agg(F.max_by("model", "mean_auc")).first()[0], table


def platt(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """Logistic calibration of a score column."""
    model = fit_logistic(assemble(df, [p]), y, balanced=False)
    return score(model, assemble(df, [p]), "calibrated").drop("features")


GRADES = ("A+", "A", "A-", "B+", "B", "B-", "C+", "C", "C-", "D+", "D", "D-")


def risk_grade(p: Column) -> Column:
    """Twelve equal bands of the probability, A+ to D-."""
    return banded(p, [(i + 1) / 12 for i in range(11)], GRADES)


def save_models(models: Mapping[str, Model], folder: str, meta: Mapping[str, object]) -> None:
    for name, m in models.items():
        PipelineModel([m]).write().overwrite().save(f"{folder}/{name}")
    spark = SparkSession.getActiveSession()
    text = json.dumps({"models": sorted(models), **meta}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/metadata")


def load_models(spark: SparkSession, folder: str) -> tuple[dict[str, Model], dict]:
    meta = json.loads(spark.read.text(f"{folder}/metadata").first()[0])
    return {n: PipelineModel.load(f"{folder}/{n}").stages[0] for n in meta["models"]}, meta


def retrain(old: Model | None, train: DataFrame, test: DataFrame, fit: Fit, needed: bool, y: str = "y") -> tuple[Model | None, dict]:
    """Refit when the decision says so, keep the better model, return it with a log record."""
    from riskloom.operators.drift import better_model

    if not needed:
        return old, {"action": "skipped"}
    new = fit(train)
    if old is None:
        return new, {"action": "replaced", "reason": "no previous model"}
    both = score(new, score(old, test, "p_old"), "p_new")
    row = better_model(both, "p_old", "p_new", y).first()
    kept = new if row["new_is_better"] else old
    return kept, {"action": "replaced" if row["new_is_better"] else "kept", **row.asDict()}
