"""Classifier metrics on (y, p) rows.

Everything that needs an order works on the table of distinct scores (`by_score`): one
row per score with its positives and negatives. That settles ties, shrinks the data with
a partial aggregate, and leaves running sums over slices instead of a global sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.scan import row_ranks, running_sums

# ---- fixed values -----------------------------------------------------------------
FIRST_THRESHOLD, THRESHOLD_STEP, THRESHOLDS = 0.05, 0.01, 90
THRESHOLD_METRICS = ("f1_score", "precision", "recall", "balanced_accuracy")
LOG_EPS = 1e-15
SEGMENT_MIN_ROWS = 10
# ---- end of fixed values ----------------------------------------------------------

_c = F.col
COUNTS = ("true_positives", "true_negatives", "false_positives", "false_negatives")


def _div(a: Column, b: Column) -> Column:
    """a / b, 0 on an empty divisor."""
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def confusion(df: DataFrame, threshold: float = 0.5, by: Sequence[str] = (), p: str = "p", y: str = "y") -> DataFrame:
    hit, pos = _c(p) >= threshold, _c(y) == 1
    n = lambda cond: F.count(F.when(cond, 1))
    return df.groupBy(*by).agg(
        n(hit & pos).alias("true_positives"),
        n(~hit & ~pos).alias("true_negatives"),
        n(hit & ~pos).alias("false_positives"),
        n(~hit & pos).alias("false_negatives"),
        F.count(F.lit(1)).alias("total_samples"),
        F.avg(_c(y).cast("double")).alias("default_rate"),
    )


def add_threshold_metrics(df: DataFrame) -> DataFrame:
    """Rates of the four counts."""
    tp, tn, fp, fn = (_c(c) for c in COUNTS)
    return df.withColumns(
        {
            "accuracy": _div(tp + tn, tp + tn + fp + fn),
            "precision": _div(tp, tp + fp),
            "recall": _div(tp, tp + fn),
            "f1_score": _div(2 * tp, 2 * tp + fp + fn),
            "specificity": _div(tn, tn + fp),
            "npv": _div(tn, tn + fn),
            "ppv": _div(tp, tp + fp),
        }
    )


def threshold_metrics(df: DataFrame, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    return add_threshold_metrics(confusion(df, threshold, by))


def by_score(df: DataFrame, by: Sequence[str] = (), p: str = "p", y: str = "y") -> DataFrame:
    return df.groupBy(*by, p).agg(
        F.count(F.when(_c(y) == 1, 1)).alias("pos"), F.count(F.when(_c(y) != 1, 1)).alias("neg")
    )


def all_metrics(
    df: DataFrame, by: Sequence[str] = (), threshold: float = 0.5, p: str = "p", y: str = "y"
) -> DataFrame:
    """Counts, rates, AUC, average precision, log loss and Brier score; one row per `by`.

    With one class only, AUC is 0.5, average precision 0 and log loss infinite.
    """
    scores = by_score(df, by, p, y)
    run = running_sums(scores, p, ["pos", "neg"], by=by)
    pos, neg = _c("pos").cast("double"), _c("neg").cast("double")
    hit = _c(p) >= threshold
    below = _c("neg_run") - _c("neg")  # negatives with a lower score
    above_pos = _c("pos_all") - _c("pos_run") + _c("pos")  # positives at or above
    above_neg = _c("neg_all") - _c("neg_run") + _c("neg")
    q = F.greatest(F.least(_c(p), F.lit(1 - LOG_EPS)), F.lit(LOG_EPS))
    zero = F.lit(0)
    sums = run.groupBy(*by).agg(
        F.sum(F.when(hit, _c("pos")).otherwise(zero)).alias("true_positives"),
        F.sum(F.when(~hit, _c("neg")).otherwise(zero)).alias("true_negatives"),
        F.sum(F.when(hit, _c("neg")).otherwise(zero)).alias("false_positives"),
        F.sum(F.when(~hit, _c("pos")).otherwise(zero)).alias("false_negatives"),
        F.sum(_c("pos") + _c("neg")).alias("total_samples"),
        F.sum(pos * (below + neg / 2)).alias("__pairs"),
        F.sum(pos * above_pos / (above_pos + above_neg)).alias("__ap"),
        F.sum(-pos * F.log(q) - neg * F.log(1 - q)).alias("__log"),
        F.sum(pos * (1 - q) * (1 - q) + neg * q * q).alias("__sq"),
        F.max("pos_all").alias("__p"),
        F.max("neg_all").alias("__n"),
    )
    both = (_c("__p") > 0) & (_c("__n") > 0)
    rated = add_threshold_metrics(sums)
    return rated.select(
        *by,
        *COUNTS,
        "total_samples",
        (_c("__p") / _c("total_samples")).alias("default_rate"),
        "accuracy",
        "precision",
        "recall",
        "f1_score",
        "specificity",
        "npv",
        "ppv",
        F.when(both, _c("__pairs") / (_c("__p").cast("double") * _c("__n"))).otherwise(F.lit(0.5)).alias("auc_roc"),
        F.when(both, _c("__ap") / _c("__p")).otherwise(F.lit(0.0)).alias("auc_pr"),
        F.when(both, _c("__log") / _c("total_samples")).otherwise(F.lit(float("inf"))).alias("log_loss"),
        (_c("__sq") / _c("total_samples")).alias("brier_score"),
    )


def auc_roc(df: DataFrame, by: Sequence[str] = (), p: str = "p", y: str = "y") -> DataFrame:
    run = running_sums(by_score(df, by, p, y), p, ["pos", "neg"], by=by)
    pairs = _c("pos").cast("double") * (_c("neg_run") - _c("neg") + _c("neg") / 2)
    sums = run.groupBy(*by).agg(
        F.sum(pairs).alias("__pairs"), F.max("pos_all").alias("__p"), F.max("neg_all").alias("__n")
    )
    auc = F.when(
        (_c("__p") > 0) & (_c("__n") > 0), _c("__pairs") / (_c("__p").cast("double") * _c("__n"))
    ).otherwise(F.lit(0.5))
    return sums.select(*by, auc.alias("auc_roc"))


def average_precision(df: DataFrame, by: Sequence[str] = (), p: str = "p", y: str = "y") -> DataFrame:
    return all_metrics(df, by, p=p, y=y).select(*by, "auc_pr")


def log_loss(df: DataFrame, by: Sequence[str] = (), p: str = "p", y: str = "y") -> DataFrame:
    """Log loss and Brier score: row means, no order needed."""
    q = F.greatest(F.least(_c(p), F.lit(1 - LOG_EPS)), F.lit(LOG_EPS))
    yd = _c(y).cast("double")
    return df.groupBy(*by).agg(
        F.avg(-(yd * F.log(q) + (1 - yd) * F.log(1 - q))).alias("log_loss"),
        F.avg((q - yd) * (q - yd)).alias("brier_score"),
    )


def threshold_value(k: Column) -> Column:
    return F.lit(FIRST_THRESHOLD) + k * F.lit(THRESHOLD_STEP)


def threshold_table(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """Counts and metrics of all thresholds from one pass: a score is counted once, in the
    cell of the highest threshold it reaches, and the cells are summed from above."""
    guess = F.floor((_c(p) - FIRST_THRESHOLD) / THRESHOLD_STEP)
    k = guess + F.when(threshold_value(guess + 1) <= _c(p), 1).otherwise(0) - F.when(
        threshold_value(guess) > _c(p), 1
    ).otherwise(0)
    cell = F.greatest(F.least(k, F.lit(THRESHOLDS - 1)), F.lit(-1)).cast("int")
    cells = df.select(cell.alias("k"), y).groupBy("k").agg(
        F.count(F.when(_c(y) == 1, 1)).alias("pos"), F.count(F.when(_c(y) != 1, 1)).alias("neg")
    )
    # Thresholds that no score stops at are needed too: 91 rows.
    grid = df.sparkSession.range(-1, THRESHOLDS).select(_c("id").cast("int").alias("k"))
    full = grid.join(cells, "k", "left").fillna(0)
    from_top = Window.orderBy(_c("k").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = full.select(
        "k",
        F.sum("pos").over(from_top).alias("true_positives"),
        F.sum("neg").over(from_top).alias("false_positives"),
        F.sum("pos").over(everything).alias("__p"),
        F.sum("neg").over(everything).alias("__n"),
    ).where("k >= 0")
    rated = add_threshold_metrics(
        counted.withColumns(
            {
                "false_negatives": _c("__p") - _c("true_positives"),
                "true_negatives": _c("__n") - _c("false_positives"),
            }
        )
    )
    return rated.select(
        "k",
        threshold_value(_c("k")).alias("threshold"),
        "f1_score",
        "precision",
        "recall",
        ((_c("recall") + _div(_c("__n"), _c("__p") + _c("__n"))) / 2).alias("balanced_accuracy"),
        ((_c("recall") + _c("specificity")) / 2).alias("true_balanced_accuracy"),
    )


def optimize_threshold(df: DataFrame, metrics: Sequence[str] = THRESHOLD_METRICS) -> DataFrame:
    """(metric, threshold, score): the first threshold of the best score; 0.5 if none is above 0."""
    table = threshold_table(df)
    best = table.agg(
        *[F.max_by(F.struct("threshold", m), F.struct(_c(m), -_c("k"))).alias(m) for m in metrics]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                F.when(_c(m)[m] > 0, _c(m)["threshold"]).otherwise(F.lit(0.5)).alias("threshold"),
                _c(m)[m].alias("score"),
            )
            for m in metrics
        ]
    )
    return best.select(F.explode(rows).alias("r")).select("r.*")


def calibration(df: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width, left-closed bins of the score; a score of 1 is in no bin."""
    cell = F.floor(_c("p") * bins).cast("int")
    per = df.where((_c("p") >= 0) & (_c("p") < 1)).groupBy(cell.alias("bin")).agg(
        F.avg("p").alias("mean_predicted"),
        F.avg(_c("y").cast("double")).alias("mean_observed"),
        F.count(F.lit(1)).alias("count"),
    )
    return per.select(
        ((_c("bin") + 0.5) / bins).alias("bin_center"),
        "mean_predicted",
        "mean_observed",
        "count",
        F.abs(_c("mean_predicted") - _c("mean_observed")).alias("gap"),
    )


def calibration_summary(df: DataFrame, bins: int = 10) -> DataFrame:
    return calibration(df, bins).agg(
        (F.sum(_c("count") * _c("gap")) / F.sum("count")).alias("ece"),
        F.avg("gap").alias("mean_gap"),
        F.max("gap").alias("max_gap"),
    )


def calibration_points(df: DataFrame) -> DataFrame:
    """Nine bins around .1 … .9, half-width .05, left-closed."""
    cell = F.floor(_c("p") * 10 + 0.5).cast("int")
    return (
        df.groupBy(cell.alias("k"))
        .agg(F.avg(_c("y").cast("double")).alias("actual_rate"), F.count(F.lit(1)).alias("count"))
        .where("k between 1 and 9")
        .select((_c("k") / 10).alias("predicted_bin"), "actual_rate", "count")
    )


def lift(df: DataFrame, groups: int = 10, key: str = "loan_id") -> DataFrame:
    """Rows by falling score in equal groups of ⌊n/groups⌋ rows (the rest is left out);
    equal scores in key order."""
    ranked = row_ranks(df.select(key, "p", "y"), "p", key, "__rank", descending=True)
    total = df.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg(_c("y").cast("double")).alias("rate")).alias("s")).scalar()
    size = F.floor(total["n"] / groups)
    per = (
        ranked.select(F.floor((_c("__rank") - 1) / size).cast("int").alias("g"), "y")
        .groupBy("g")
        .agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("count"))
        .where(_c("g") < groups)
    )
    up = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rate = _c("pos") / _c("count")
    return per.select(
        (_c("g") + 1).alias("decile"),
        rate.alias("default_rate"),
        F.when(total["rate"] > 0, rate / total["rate"]).otherwise(F.lit(0.0)).alias("lift"),
        (F.sum("pos").over(up) / F.sum("count").over(up)).alias("cumulative_default_rate"),
        "count",
    )


def metrics_by(df: DataFrame, segment: str) -> DataFrame:
    """All metrics per segment with more than ten rows."""
    return all_metrics(df, by=[segment]).where(_c("total_samples") > SEGMENT_MIN_ROWS)


def as_rows(df: DataFrame, section: str, cols: Sequence[str], name: Column | None = None) -> DataFrame:
    """Columns of a small result as (section, metric, value) rows."""
    pairs = [F.struct(F.lit(c).alias("metric"), _c(c).cast("double").alias("value")) for c in cols]
    flat = df.select(F.explode(F.array(*pairs)).alias("r"))
    return flat.select(F.lit(section).alias("section"), "r.metric", "r.value")


def evaluation_report(df: DataFrame, key: str = "loan_id") -> DataFrame:
    """Tidy report: overall metrics, best thresholds, calibration gaps, top-decile lift."""
    overall = all_metrics(df)
    best = optimize_threshold(df).select(F.lit("optimal_thresholds").alias("section"), "metric", _c("threshold").alias("value"))
    gaps = as_rows(calibration_summary(df), "calibration_summary", ["mean_gap", "max_gap"])
    top = lift(df, key=key).where("decile = 1").select(
        _c("lift").alias("top_decile_lift"), _c("cumulative_default_rate").alias("top_decile_capture")
    )
    return (
        as_rows(overall, "overall_metrics", overall.columns)
        .unionByName(best)
        .unionByName(gaps)
        .unionByName(as_rows(top, "lift_summary", ["top_decile_lift", "top_decile_capture"]))
    )


def compare_models(df: DataFrame, models: Sequence[str], model: str = "model") -> DataFrame:
    """Metric × model matrix of (model, y, p) rows."""
    wide = all_metrics(df, by=[model])
    names = [c for c in wide.columns if c != model]
    pairs = [F.struct(F.lit(c).alias("metric"), _c(c).cast("double").alias("value")) for c in names]
    long = wide.select(model, F.explode(F.array(*pairs)).alias("r")).select(model, "r.metric", "r.value")
    return long.groupBy("metric").pivot(model, list(models)).agg(F.max("value"))
