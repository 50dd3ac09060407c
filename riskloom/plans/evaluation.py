"""Metrics on the `scored` view."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import evaluate as E
from riskloom.plans.registry import case
from riskloom.plans.tables import Tables

COUNT_SQL = """count(case when p >= 5e-1 and y = 1 then 1 end) as true_positives, count(case when p < 5e-1 and y = 0 then 1 end) as true_negatives,
  count(case when p >= 5e-1 and y = 0 then 1 end) as false_positives, count(case when p < 5e-1 and y = 1 then 1 end) as false_negatives,
  count(*) as total_samples, avg(y) as default_rate"""


def d(a: str, b: str) -> str:
    return f"case when {b} > 0 then ({a}) / cast({b} as double) else 0e0 end"


RATES = f"""{d('true_positives + true_negatives', '(true_positives + true_negatives + false_positives + false_negatives)')} as accuracy,
  {d('true_positives', '(true_positives + false_positives)')} as precision, {d('true_positives', '(true_positives + false_negatives)')} as recall,
  {d('2 * true_positives', '(2 * true_positives + false_positives + false_negatives)')} as f1_score,
  {d('true_negatives', '(true_negatives + false_positives)')} as specificity, {d('true_negatives', '(true_negatives + false_negatives)')} as npv,
  {d('true_positives', '(true_positives + false_positives)')} as ppv"""
RATE_COLS = "accuracy precision recall f1_score specificity npv ppv"


@case("e1_confusion", f"select {COUNT_SQL} from scored", r6="default_rate")
def _(t: Tables):
    return E.confusion(t.scored)


@case("e2_threshold_metrics", f"select *, {RATES} from (select {COUNT_SQL} from scored) c", r6="default_rate " + RATE_COLS)
def _(t: Tables):
    return E.threshold_metrics(t.scored)


def rank_sql(rel: str, by: str = "", p: str = "p") -> str:
    """AUC and average precision per group, from ranks."""
    g = f"{by}, " if by else ""
    part = f"partition by {by} " if by else ""
    return f"""sc as (select {g}{p} as p, sum(y) as pos, sum(1 - y) as neg from {rel} group by {g}{p}),
  ru as (select *, sum(neg) over ({part}order by p) as nr, sum(pos) over ({part}order by p desc) as pa, sum(neg) over ({part}order by p desc) as na from sc),
  au as (select {g}case when sum(pos) > 0 and sum(neg) > 0 then cast(sum(pos * (nr - neg + neg / 2e0)) as double) / (cast(sum(pos) as double) * cast(sum(neg) as double)) else 5e-1 end as auc_roc,
    case when sum(pos) > 0 and sum(neg) > 0 then sum(cast(pos as double) * cast(pa as double) / cast(pa + na as double)) / cast(sum(pos) as double) else 0e0 end as auc_pr from ru {'group by ' + by if by else ''})"""


@case("e3_auc_roc", f"with {rank_sql('scored')} select auc_roc from au", r6="auc_roc")
def _(t: Tables):
    return E.auc_roc(t.scored)


@case("e4_auc_pr", f"with {rank_sql('scored')} select auc_pr from au", r6="auc_pr")
def _(t: Tables):
    return E.average_precision(t.scored)


LOSSES = """avg(-(y * ln(greatest(least(p, 1 - 1e-15), 1e-15)) + (1 - y) * ln(1 - greatest(least(p, 1 - 1e-15), 1e-15)))) as log_loss,
  avg((p - y) * (p - y)) as brier_score"""


@case("e5_log_loss_brier", f"select {LOSSES} from scored", r6="log_loss brier_score")
def _(t: Tables):
    return E.log_loss(t.scored)


@case(
    "e6_metrics_single_class",
    """select count(*) as total_samples, 5e-1 as auc_roc, 0e0 as auc_pr, cast('inf' as double) as log_loss, avg((p - y) * (p - y)) as brier_score
    from scored where y = 1""",
    r6="brier_score",
)
def _(t: Tables):
    m = E.all_metrics(t.scored.where("y = 1"))
    return m.select("total_samples", "auc_roc", "auc_pr", "log_loss", "brier_score")


ALL_DOUBLES = f"default_rate {RATE_COLS} auc_roc auc_pr log_loss brier_score"


@case(
    "e7_all_metrics",
    f"""with {rank_sql('scored')}, c as (select {COUNT_SQL}, {LOSSES} from scored)
    select c.* exclude (log_loss, brier_score), {RATES}, auc_roc, auc_pr, log_loss, brier_score from c, au""",
    r6=ALL_DOUBLES,
)
def _(t: Tables):
    return E.all_metrics(t.scored)


TH = f"""g as (select k, 5e-2 + k * 1e-2 as threshold from (select unnest(range(0, 90)) as k) r),
  tc as (select k, threshold, count(case when p >= threshold and y = 1 then 1 end) as true_positives, count(case when p >= threshold and y = 0 then 1 end) as false_positives,
    count(case when p < threshold and y = 1 then 1 end) as false_negatives, count(case when p < threshold and y = 0 then 1 end) as true_negatives from scored cross join g group by k, threshold),
  tm as (select *, (recall + (false_positives + true_negatives) / cast(true_positives + false_positives + false_negatives + true_negatives as double)) / 2 as balanced_accuracy
    from (select *, {RATES} from tc) z)"""


@case(
    "e8_optimize_threshold",
    f"with {TH} "
    + " union all ".join(
        f"select '{m}' as metric, threshold, {m} as score from (select * from tm order by {m} desc, k limit 1) z{i}"
        for i, m in enumerate(E.THRESHOLD_METRICS)
    ),
    r6="threshold score",
)
def _(t: Tables):
    return E.optimize_threshold(t.scored)


CAL = """cal as (select floor(p * 10) as b, avg(p) as mean_predicted, avg(y) as mean_observed, count(*) as count from scored where p >= 0 and p < 1 group by 1),
  calg as (select (b + 5e-1) / 10 as bin_center, mean_predicted, mean_observed, count, abs(mean_predicted - mean_observed) as gap from cal)"""


@case("e9_calibration", f"with {CAL} select * from calg", r6="bin_center mean_predicted mean_observed gap")
def _(t: Tables):
    return E.calibration(t.scored)


@case(
    "e9_calibration_summary",
    f"with {CAL} select sum(count * gap) / sum(count) as ece, avg(gap) as mean_gap, max(gap) as max_gap from calg",
    r6="ece mean_gap max_gap",
)
def _(t: Tables):
    return E.calibration_summary(t.scored)


@case(
    "e10_calibration_points",
    """select k / 1e1 as predicted_bin, avg(y) as actual_rate, count(*) as count from (select cast(floor(p * 10 + 5e-1) as int) as k, y from scored) z
    where k between 1 and 9 group by k""",
    r6="predicted_bin actual_rate",
)
def _(t: Tables):
    return E.calibration_points(t.scored)


LIFT = """rk as (select y, row_number() over (order by p desc, loan_id) - 1 as r, count(*) over () // 10 as size, avg(y) over () as base from scored),
  lf as (select cast(r // size as int) + 1 as decile, avg(y) as default_rate, avg(y) / max(base) as lift, sum(y) as pos, count(*) as count from rk where r // size < 10 group by 1),
  lift as (select decile, default_rate, lift, sum(pos) over (order by decile) / cast(sum(count) over (order by decile) as double) as cumulative_default_rate, count from lf)"""


@case("e11_lift", f"with {LIFT} select * from lift", r6="default_rate lift cumulative_default_rate")
def _(t: Tables):
    return E.lift(t.scored)


@case(
    "e12_metrics_by_segment",
    f"""with {rank_sql('scored', 'segment')}, c as (select segment, {COUNT_SQL}, {LOSSES} from scored group by segment having count(*) > 10)
    select c.* exclude (log_loss, brier_score), {RATES}, auc_roc, auc_pr, log_loss, brier_score from c join au on au.segment = c.segment""",
    r6=ALL_DOUBLES,
)
def _(t: Tables):
    return E.metrics_by(t.scored, "segment")


REPORT_COLS = [*E.COUNTS, "total_samples", *ALL_DOUBLES.split()]


@case(
    "e13_evaluation_report",
    f"""with {rank_sql('scored')}, c as (select {COUNT_SQL}, {LOSSES} from scored), a as (select c.*, {RATES}, auc_roc, auc_pr from c, au), {TH}, {CAL}, {LIFT} """
    + " union all ".join(
        [f"select 'overall_metrics' as section, '{m}' as metric, cast({m} as double) as value from a" for m in REPORT_COLS]
        + [
            f"select 'optimal_thresholds', '{m}', threshold from (select * from tm order by {m} desc, k limit 1) z{i}"
            for i, m in enumerate(E.THRESHOLD_METRICS)
        ]
        + [
            "select 'calibration_summary', 'mean_gap', avg(gap) from calg",
            "select 'calibration_summary', 'max_gap', max(gap) from calg",
            "select 'lift_summary', 'top_decile_lift', lift from lift where decile = 1",
            "select 'lift_summary', 'top_decile_capture', cumulative_default_rate from lift where decile = 1",
        ]
    ),
    r6="value",
)
def _(t: Tables):
    return E.evaluation_report(t.scored)


TWO = """m as (select 'a' as model, y, p from scored union all select 'b', y, p * p from scored)"""


@case(
    "e14_compare_models",
    f"""with {TWO}, {rank_sql('m', 'model')}, c as (select model, {COUNT_SQL}, {LOSSES} from m group by model),
    w as (select c.*, {RATES}, auc_roc, auc_pr from c join au on au.model = c.model) """
    + " union all ".join(
        f"select '{m}' as metric, max(case when model = 'a' then cast({m} as double) end) as a, max(case when model = 'b' then cast({m} as double) end) as b from w"
        for m in REPORT_COLS
    ),
    r6="a b",
)
def _(t: Tables):
    s = t.scored
    two = s.select(F.lit("a").alias("model"), "y", "p").unionByName(
        s.select(F.lit("b").alias("model"), "y", (F.col("p") * F.col("p")).alias("p"))
    )
    return E.compare_models(two, ["a", "b"])
