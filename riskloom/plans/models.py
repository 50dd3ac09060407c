"""Models on labelled loans (rows only), score arithmetic and explanations (with SQL)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskloom.operators import explain as X
from riskloom.operators import model as M
from riskloom.operators.evaluate import all_metrics
from riskloom.operators.loan import default_label
from riskloom.operators.prep import kfold, stratified_split
from riskloom.operators.pricing import heuristic_score
from riskloom.plans.registry import case, money
from riskloom.plans.tables import Tables
from riskloom.session import cut_lineage, scratch_dir

FEATURES = (
    "months_since_issue", "credit_score", "debt_to_income", "total_credit_utilization", "employment_length", "num_derogatory_records",
)
SHOWN = ("auc_roc", "auc_pr", "accuracy", "brier_score", "total_samples")


def data(t: Tables):
    """Labelled loans with a feature vector, written once: fits read it many times."""
    df = default_label(t.loans, out="y").select("loan_id", "loan_type", "y", *FEATURES)
    return cut_lineage(M.assemble(df, FEATURES))


def fits():
    """Small settings for the test tables; the defaults of the library are larger."""
    return {
        "logistic": lambda d: M.fit_logistic(d, max_iter=50),
        "forest": lambda d: M.fit_forest(d, trees=10, depth=5),
    }


def boosted(d):
    return M.fit_boosted(d, rounds=5, depth=3, step=0.3)


def split(t: Tables):
    df = data(t)
    parts = cut_lineage(stratified_split(df, "y", "loan_id"))
    return tuple(parts.where(F.col("part") == p).drop("part") for p in ("train", "val", "test"))


def metrics_of(model, df):
    return all_metrics(M.score(model, df)).select(*SHOWN)


@case("m1_fit_logistic")
def _(t: Tables):
    train, _, test = split(t)
    return metrics_of(fits()["logistic"](train), test)


@case("m2_fit_forest")
def _(t: Tables):
    train, _, test = split(t)
    return metrics_of(fits()["forest"](train), test)


@case("m3_fit_boosted")
def _(t: Tables):
    train, _, test = split(t)
    return metrics_of(boosted(train), test)


@case("m4_fit_stacking")
def _(t: Tables):
    train, _, test = split(t)
    models, meta = M.fit_stacking(train, fits(), "loan_id", folds=2)
    return all_metrics(M.score_stacking(models, meta, test)).select(*SHOWN)


TWO = "select loan_id, y, p as a, p * p as b, sqrt(p) * 9e-1 as c from scored"
MODELS = {"a": "a", "b": "b", "c": "c"}


def two(t: Tables):
    return t.sql(TWO)


@case(
    "m5_auc_weights",
    f"""with s as ({TWO}), l as (select 'a' as model, y, a as p from s union all select 'b', y, b from s union all select 'c', y, case when loan_id % 2 = 0 then c else 1 - c end from s),
    sc as (select model, p, sum(y) as pos, sum(1 - y) as neg from l group by 1, 2), ru as (select *, sum(neg) over (partition by model order by p) as nr from sc),
    au as (select model, cast(sum(pos * (nr - neg + neg / 2e0)) as double) / (cast(sum(pos) as double) * cast(sum(neg) as double)) as auc_roc from ru group by model)
    select model, auc_roc, auc_roc / sum(auc_roc) over () as weight from au""",
    r6="auc_roc weight",
)
def _(t: Tables):
    df = two(t).withColumn("c", F.when(F.col("loan_id") % 2 == 0, F.col("c")).otherwise(1 - F.col("c")))
    return M.auc_weights(df, MODELS)


@case("m6_calibrate_isotonic")
def _(t: Tables):
    s = t.scored.select("loan_id", "y", "p")
    model = M.calibrate_isotonic(s)
    return model.transform(s.withColumn("p", F.col("p").cast("double"))).groupBy("y").agg(
        F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("mean_calibrated")
    )


@case("m7_train_all")
def _(t: Tables):
    train, val, _ = split(t)
    _, table, best = M.train_all(train, val, {**fits(), "boosted": boosted})
    return table.select("model", *SHOWN).withColumn("best", F.col("model") == best)


@case("m8_cross_validate")
def _(t: Tables):
    return M.cross_validate(data(t), {"logistic": fits()["logistic"]}, "loan_id", folds=3)


@case("m9_fit_per_group")
def _(t: Tables):
    df = data(t)
    models = M.fit_per_group(df, "loan_type", lambda d: M.fit_logistic(d, max_iter=20))
    rows = [M.score(m, df.where(F.col("loan_type") == k)) for k, m in sorted(models.items())]
    from functools import reduce

    return all_metrics(reduce(lambda a, b: a.unionByName(b), rows), by=["loan_type"]).select("loan_type", *SHOWN)


@case("m9_grouped_logistic")
def _(t: Tables):
    """All loan types fitted at once by IRLS, then scored and measured per type. Property test:
    tests/test_operators.py::test_grouped_logistic_equals_single_fits."""
    from riskloom.operators.grouped import fit_logistic_groups, score_groups

    df = default_label(t.loans, out="y").select("loan_id", "loan_type", "y", *FEATURES)
    models = cut_lineage(fit_logistic_groups(df, "loan_type", FEATURES))
    scored = score_groups(df, models, "loan_type", FEATURES).where(F.col("p").isNotNull())
    return all_metrics(scored, by=["loan_type"]).select("loan_type", *SHOWN)


@case("m10_score")
def _(t: Tables):
    df = data(t)
    return M.score(fits()["logistic"](df), df).select("loan_id", "p")


CLASS = "case when x <= 0 or x > 1 then null when x <= 1e-1 then 'Very Low' when x <= 25e-2 then 'Low' when x <= 5e-1 then 'Medium' when x <= 75e-2 then 'High' else 'Very High' end"


@case(
    "m11_score_ensemble",
    f"""with s as (select *, a * 5e-1 + b * 3e-1 + c * 2e-1 as x, (a + b + c) / 3 as m from ({TWO}) z)
    select loan_id, x as ensemble_default_probability, x * 100 as ensemble_risk_score, (power(a - m, 2) + power(b - m, 2) + power(c - m, 2)) / 3 as prediction_variance,
      {CLASS} as risk_category, case when x >= 5e-1 then 1 else 0 end as ensemble_pred from s""",
    r6="ensemble_default_probability prediction_variance",
    r2="ensemble_risk_score",
)
def _(t: Tables):
    out = M.score_ensemble(two(t), MODELS, {"a": 0.5, "b": 0.3, "c": 0.2})
    return out.drop("y", "a", "b", "c").withColumn("ensemble_risk_score", F.col("ensemble_default_probability") * 100)


@case(
    "m12_score_with_interval",
    f"""with s as (select *, (a + b + c) / 3 as m from ({TWO}) z), d as (select *, sqrt((power(a - m, 2) + power(b - m, 2) + power(c - m, 2)) / 3) as sd from s),
    i as (select *, greatest(least(m - {M.Z95!r} * sd, 1e0), 0e0) as lo, greatest(least(m + {M.Z95!r} * sd, 1e0), 0e0) as hi from d)
    select loan_id, m as mean_proba, sd as std_proba, lo as ci_lower, hi as ci_upper, case when m >= 5e-1 then 1 else 0 end as prediction, 1 - (hi - lo) as confidence from i""",
    r6="mean_proba std_proba ci_lower ci_upper confidence",
)
def _(t: Tables):
    return M.score_with_interval(two(t), ["a", "b", "c"]).drop("y", "a", "b", "c")


@case(
    "m13_horizon_12m",
    """with s as (select loan_id, least(p * (case when loan_id % 13 > 0 then 1 + (loan_id % 13) / 12e0 * 3e-1 else 1e0 end), 1e0) as x from scored)
    select loan_id, x as adjusted_12m_probability, case when x > 5e-1 then 'Within 6 months' when x > 25e-2 then 'Within 12 months' else 'Low risk (12+ months)' end as estimated_default_horizon from s""",
    r6="adjusted_12m_probability",
)
def _(t: Tables):
    df = t.scored.withColumn("delinquency_months", (F.col("loan_id") % 13).cast("int"))
    return M.horizon_12m(df).select("loan_id", "adjusted_12m_probability", "estimated_default_horizon")


@case("m14_permutation_importance")
def _(t: Tables):
    df = data(t)
    return M.permutation_importance(fits()["forest"](df), df, FEATURES, "loan_id")


@case("m15_tree_importance")
def _(t: Tables):
    return M.tree_importance(fits()["forest"](data(t)), FEATURES, t.spark)


# A fixed linear score: its attributions can be checked in SQL.
COEF = {
    "credit_score": -0.004, "debt_to_income": 1.2, "total_credit_utilization": 0.8, "employment_length": -0.03, "num_derogatory_records": 0.25,
}
INTERCEPT = -0.4
AT = f"""mm as (select {", ".join(f"avg({f}) as {f}" for f in COEF)} from loans),
  att as (select l.loan_id, l.borrower_segment, unnest([{", ".join(f"'{f}'" for f in COEF)}]) as feature, unnest([{", ".join(f"cast(l.{f} as double)" for f in COEF)}]) as value,
    unnest([{", ".join(f"(l.{f} - mm.{f}) * {w!r}::double" for f, w in COEF.items())}]) as contribution from loans l cross join mm),
  rk as (select *, row_number() over (partition by loan_id order by abs(contribution) desc, feature) as k from att),
  pr as (select loan_id, 1 / (1 + exp(-({INTERCEPT!r}::double + sum(contribution)))) as p from att group by loan_id)"""


def explained(t: Tables):
    df = t.loans.select("loan_id", "borrower_segment", *COEF)
    rows = X.linear_attributions(df, COEF, X.feature_means(df, list(COEF)))
    total = F.aggregate("attributions", F.lit(INTERCEPT), lambda acc, a: acc + a["contribution"])
    return rows.withColumn("p", 1 / (1 + F.exp(-total)))


def told(t: Tables):
    return X.rank_attributions(explained(t))


@case("m16_attributions", f"with {AT} select loan_id, feature, value, contribution from att", r6="value contribution")
def _(t: Tables):
    return X.long_form(explained(t), ["loan_id"])


@case("m16_sampled_attributions")
def _(t: Tables):
    df = data(t)
    orders = [FEATURES, FEATURES[::-1]]
    return X.sampled_attributions(fits()["forest"](df), df, "loan_id", FEATURES, orders).groupBy("feature").agg(
        F.avg(F.abs("contribution")).alias("mean_abs")
    )


@case(
    "m17_rank_attributions",
    f"""with {AT} select loan_id, string_agg(feature, ',' order by k) as ranking, string_agg(case when contribution > 0 then feature end, ',' order by k) as risk_factors,
      string_agg(case when contribution <= 0 then feature end, ',' order by k) as protective_factors from rk group by loan_id""",
)
def _(t: Tables):
    names = lambda c: F.nullif(F.array_join(F.transform(c, lambda a: a["feature"]), ","), F.lit("")).alias(c)
    return told(t).select("loan_id", names("ranking"), names("risk_factors"), names("protective_factors"))


@case("m18_global_attributions", f"with {AT} select feature, avg(abs(contribution)) as mean_abs from att group by feature", r6="mean_abs")
def _(t: Tables):
    return X.global_attributions(explained(t))


@case(
    "m18_pair_strength",
    f"""with {AT}, g as (select feature, row_number() over (order by avg(abs(contribution)) desc, feature) as r from att group by feature),
    x as (select att.*, g.r from att join g on g.feature = att.feature)
    select a.feature || ' x ' || b.feature as pair, avg(abs(a.contribution * b.contribution)) as strength from x a join x b on a.loan_id = b.loan_id and a.r < b.r group by 1""",
    r6="strength",
)
def _(t: Tables):
    return X.pair_strength(explained(t))


@case(
    "m18_attributions_by_half",
    f"""with {AT}, md as (select median(credit_score) as m from loans), h as (select loan_id, case when credit_score <= m then 'low' else 'high' end as half from loans cross join md)
    select half, feature, avg(abs(contribution)) as mean_abs from att join h on h.loan_id = att.loan_id group by 1, 2""",
    r6="mean_abs",
)
def _(t: Tables):
    return X.attributions_by_half(explained(t), "credit_score")


@case(
    "m19_attributions_by_segment",
    f"""with {AT}, s as (select l.borrower_segment, count(*) as segment_size, avg(p) as mean_probability from pr join loans l on l.loan_id = pr.loan_id group by 1 having count(*) > 10),
    a as (select borrower_segment, feature, avg(abs(contribution)) as mean_abs from att group by 1, 2)
    select a.borrower_segment, feature, mean_abs, cast(row_number() over (partition by a.borrower_segment order by mean_abs desc, feature) as int) as rank, segment_size, mean_probability
    from a join s on s.borrower_segment = a.borrower_segment""",
    r6="mean_abs mean_probability",
)
def _(t: Tables):
    return X.attributions_by(explained(t), "borrower_segment")


@case(
    "m20_waterfall",
    f"""with {AT}, c as (select *, coalesce(sum(contribution) over (partition by loan_id order by k rows between unbounded preceding and 1 preceding), 0e0) as s0,
      sum(contribution) over (partition by loan_id order by k) as s1 from rk)
    select loan_id, cast(k as int) as position, feature, {money('s0', 6)} as start, {money('s1', 6)} as "end" from c""",
    r4="start end",
)
def _(t: Tables):
    return X.waterfall(told(t), ["loan_id"])


@case(
    "m21_segment_comparison",
    f"""with m as (select borrower_segment, {", ".join(f"avg({f}) as {f}" for f in COEF)} from loans group by 1),
    x as (select l.loan_id, l.borrower_segment, unnest([{", ".join(f"'{f}'" for f in COEF)}]) as feature, unnest([{", ".join(f"cast(l.{f} as double)" for f in COEF)}]) as value,
      unnest([{", ".join(f"m.{f}" for f in COEF)}]) as segment_average from loans l join m on m.borrower_segment = l.borrower_segment)
    select *, cast(row_number() over (partition by loan_id order by abs(value - segment_average) desc, feature) as int) as position, value - segment_average as difference,
      case when segment_average <> 0 then (value - segment_average) / segment_average * 100 else 0e0 end as pct_difference from x""",
    r6="value segment_average difference",
    r4="pct_difference",
)
def _(t: Tables):
    return X.segment_comparison(t.loans, "loan_id", "borrower_segment", list(COEF))


@case(
    "m22_counterfactual",
    f"""with {AT}, c as (select rk.*, case feature {" ".join(f"when '{f}' then {w!r}::double" for f, w in COEF.items())} end as w,
      case when value <> 0 then abs(value) * 3e-1 else 5e-1 end as step from rk where k <= 8 and contribution > 0),
    d as (select *, row_number() over (partition by loan_id order by k) as j from c where w > 0), e as (select loan_id, sum(w * step) as move, count(*) as n from d where j <= 3 group by loan_id)
    select pr.loan_id, p as original_score, 1 / (1 + exp(-(ln(p / (1 - p)) - coalesce(move, 0e0)))) as counterfactual_score, cast(coalesce(n, 0) as int) as n_changes from pr left join e on e.loan_id = pr.loan_id""",
    r6="original_score counterfactual_score",
)
def _(t: Tables):
    df = explained(t)
    out = X.counterfactual(df, COEF, INTERCEPT, {})
    return out.select("loan_id", "original_score", "counterfactual_score", F.size("changed_features").alias("n_changes"))


@case(
    "m23_materiality",
    f"""with {AT} select rk.loan_id, case when p < 5e-1 then 'approve' else 'decline' end as decision, sum(contribution) over (partition by rk.loan_id) as risk_score, cast(k as int) as position,
      feature as factor, value as factor_value, contribution, case when contribution > 0 then 'adverse' else 'favorable' end as direction,
      case when abs(contribution) > 1e-1 then 'high' when abs(contribution) > 5e-2 then 'medium' else 'low' end as materiality from rk join pr on pr.loan_id = rk.loan_id""",
    r4="risk_score factor_value contribution",
)
def _(t: Tables):
    return X.audit_rows(told(t), ["loan_id"])


@case(
    "m24_narrative",
    f"""with {AT}, f as (select loan_id, string_agg(case when contribution > 0 then feature end, ', ' order by k) as rf from (select *, sum(case when contribution > 0 then 1 else 0 end) over (partition by loan_id order by k) as c from rk) z
      where c <= 3 and contribution > 0 group by loan_id)
    select pr.loan_id, case when p < 3e-1 then 'Low risk applicant; Approve; ' when p < 6e-1 then 'Medium risk applicant; Review further; ' else 'High risk applicant; Decline; ' end || coalesce(rf, '') as executive,
      case when p < 3e-1 then 'The details given support this application.' when p < 6e-1 then 'We would like to look at some details of this application again.'
        else 'The details given raise doubts about this application.' end as customer_outcome
    from pr left join f on f.loan_id = pr.loan_id""",
)
def _(t: Tables):
    return X.narrative(told(t)).select("loan_id", "executive", "customer_outcome")


@case("m24_narrative_texts")
def _(t: Tables):
    df = X.explanation_text(X.narrative(told(t)))
    return df.select("loan_id", "committee", "officer", "customer_helped", "customer_improve", "explanation_text", X.api_document(df).alias("api"))


@case(
    "m25_attribution_confidence",
    f"""with {AT}, v as (select loan_id, 1 - stddev_pop(contribution) / (avg(abs(contribution)) + 1e-8) as v from att group by loan_id)
    select loan_id, case when v > 7e-1 then 'High confidence' when v > 4e-1 then 'Medium confidence' else 'Low confidence' end as confidence from v""",
)
def _(t: Tables):
    return explained(t).select("loan_id", X.attribution_confidence(F.col("attributions")).alias("confidence"))


@case("m26_consistency_report")
def _(t: Tables):
    return X.consistency_report(explained(t), "borrower_segment")


@case("m32_tune")
def _(t: Tables):
    grid = {f"c={c}": (lambda d, c=c: M.fit_logistic(d, c=c, max_iter=20)) for c in (0.01, 1.0)}
    best, table = M.tune(data(t), grid, "loan_id", folds=2)
    return table.withColumn("best", F.col("model") == best)


@case("m33_partial_dependence")
def _(t: Tables):
    df = data(t)
    return M.partial_dependence(fits()["logistic"](df), df, FEATURES, "credit_score", [300 + 50 * i for i in range(12)])


@case(
    "m34_rule_factors",
    """select loan_id, case when debt_to_income > 43e-2 then 'high' else 'moderate' end as dti_impact, case when credit_score < 620 then 'high' else 'low' end as score_impact,
      concat_ws(',', case when credit_score >= 700 then 'Credit Score' end, case when employment_length >= 5 then 'Employment Length' end) as protective from loans""",
)
def _(t: Tables):
    r = X.rule_factors(t.loans)
    return r.select(
        "loan_id",
        F.col("risk_factors")[0]["impact"].alias("dti_impact"),
        F.col("risk_factors")[1]["impact"].alias("score_impact"),
        F.array_join(F.transform("protective_factors", lambda a: a["factor"]), ",").alias("protective"),
    )


@case("d25_retrain")
def _(t: Tables):
    train, _, test = split(t)
    old = M.fit_forest(train, trees=2, depth=2)
    _, log = M.retrain(old, train, test, fits()["logistic"], needed=True)
    return t.spark.createDataFrame([(log["action"], float(log["old_auc"]), float(log["new_auc"]))], "action string, old_auc double, new_auc double")


def retrain_cycle_log(t: Tables):
    """The cycle run six times on one registry: skip, first model, better model, same model,
    two rollbacks. Property test: tests/test_operators.py::test_retrain_cycle_actions."""
    from riskloom.operators import registry as R

    train, val, test = split(t)
    reg = R.Registry(t.spark)
    logistic = lambda d: M.fit_logistic(d)
    weak = lambda d: M.fit_forest(d, trees=1, depth=1)
    R.retrain_cycle(reg, {"retrain_needed": False, "action": "continue_monitoring", "urgency": "none"}, logistic, train, val, test, M.score)
    R.retrain_cycle(reg, {"retrain_needed": True, "urgency": "scheduled"}, weak, train, val, test, M.score)
    R.retrain_cycle(reg, {"retrain_needed": True, "urgency": "immediate"}, logistic, train, val, test, M.score)
    R.retrain_cycle(reg, {"retrain_needed": True, "urgency": "immediate"}, logistic, train, val, test, M.score)
    R.rollback(reg)
    R.rollback(reg)
    return reg, reg.log().select(
        "seq", "action", "urgency", "old_auc", "new_auc", "improvement",
        F.coalesce(F.col("version_before") != F.col("version_after"), F.col("version_after").isNotNull()).alias("pointer_moved"),
    )


@case("d25_retrain_cycle")
def _(t: Tables):
    return retrain_cycle_log(t)[1]


@case("s11_save_load_model")
def _(t: Tables):
    df = data(t)
    folder = f"{scratch_dir(t.spark)}/riskloom/models-{uuid.uuid4().hex}"
    M.save_models({"logistic": fits()["logistic"](df)}, folder, {"best_model": "logistic"})
    models, _ = M.load_models(t.spark, folder)
    return metrics_of(models["logistic"], df)


GRADE_BANDS = " ".join(f"when p < {(i + 1) / 12!r}::double then '{g}'" for i, g in enumerate(M.GRADES[:11]))


@case("g26_risk_grade", f"select loan_id, case {GRADE_BANDS} else 'D-' end as grade from scored")
def _(t: Tables):
    return t.scored.select("loan_id", M.risk_grade(F.col("p")).alias("grade"))


@case(
    "g26_reason_codes",
    f"with {AT} select l.loan_id, coalesce(string_agg(feature, ',' order by k), '') as reasons from loans l left join rk on rk.loan_id = l.loan_id and contribution > 0 group by l.loan_id",
)
def _(t: Tables):
    df = told(t)
    return df.select("loan_id", X.reason_codes(df).alias("reasons"))


@case("g26_platt")
def _(t: Tables):
    return M.platt(t.scored.select("loan_id", "y", "p")).groupBy("y").agg(F.avg("calibrated").alias("mean_calibrated"))
