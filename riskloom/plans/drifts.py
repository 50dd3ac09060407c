"""Drift operators on the loan, score and error views."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import drift as D
from riskloom.operators import evaluate as E
from riskloom.operators.scan import cut_points  # noqa: F401  (part of the public surface)
from riskloom.plans.evaluation import COUNT_SQL, LOSSES, RATES, rank_sql
from riskloom.plans.registry import case
from riskloom.plans.tables import Tables

NUM = ("loan_amount", "debt_to_income", "credit_score", "annual_income")
CAT = ("loan_type", "risk_grade", "borrower_segment")
SIDE = "case when issue_date < timestamp '1998-01-01 00:00:00' then 'ref' else 'cur' end"


def loan_sides(t: Tables):
    ref = F.col("issue_date") < F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
    return t.loans.where(ref), t.loans.where(~ref)


def long_sql(cols, name="lg") -> str:
    fs = ", ".join(f"'{c}'" for c in cols)
    vs = ", ".join(f"cast({c} as double)" for c in cols)
    return f"{name} as (select {SIDE} as side, unnest([{fs}]) as feature, unnest([{vs}]) as value from loans)"


def hist_sql(bins: int, joint: bool = False, lg: str = "lg") -> str:
    which = "" if joint else " where side = 'ref'"
    return f"""rg as (select feature, min(value) as lo, max(value) as hi from {lg}{which} group by feature),
  hb as (select x.feature, least(floor((value - lo) / (hi - lo) * {bins}), {bins - 1}) as b, count(case when side = 'ref' then 1 end) as r, count(case when side = 'cur' then 1 end) as c
    from {lg} x join rg on rg.feature = x.feature where value >= lo and value <= hi group by 1, 2),
  gb as (select rg.feature, g.b, (hi - lo) / {bins} as width from rg cross join (select unnest(range(0, {bins})) as b) g),
  hh as (select gb.feature, gb.b, gb.width, coalesce(r, 0) as r, coalesce(c, 0) as c from gb left join hb on gb.feature = hb.feature and gb.b = hb.b),
  sh as (select *, r / cast(sum(r) over (partition by feature) as double) as rs, c / cast(sum(c) over (partition by feature) as double) as cs from hh)"""


PSI = "select feature, sum((greatest(cs, 1e-6) - greatest(rs, 1e-6)) * ln(greatest(cs, 1e-6) / greatest(rs, 1e-6))) as psi from sh group by feature"


@case("d1_psi", f"with {long_sql(NUM)}, {hist_sql(10)} {PSI}", r6="psi")
def _(t: Tables):
    return D.psi(*loan_sides(t), NUM)


COMBINED = """select feature, psi, psi > 2e-1 as drift_detected, case when psi > 25e-2 then 'high' when psi > 1e-1 then 'moderate' else 'low' end as severity from
  (select feature, sum((cs - rs) * ln((cs + 1e-6) / (rs + 1e-6))) as psi from sh group by feature) z"""


@case("d2_psi_combined", f"with {long_sql(NUM)}, {hist_sql(10, True)} {COMBINED}", r6="psi")
def _(t: Tables):
    return D.psi_combined(*loan_sides(t), NUM)


def cats_sql(cols) -> str:
    fs = ", ".join(f"'{c}'" for c in cols)
    return f"""lc as (select {SIDE} as side, unnest([{fs}]) as feature, unnest([{", ".join(cols)}]) as value from loans),
  cc as (select feature, value, count(case when side = 'ref' then 1 end) as r, count(case when side = 'cur' then 1 end) as c from lc group by 1, 2),
  ct as (select *, cast(sum(r) over (partition by feature) as double) as nr, cast(sum(c) over (partition by feature) as double) as nc, count(*) over (partition by feature) as k from cc),
  cp as (select feature, sum((greatest(c / nc, 1e-6) - greatest(r / nr, 1e-6)) * ln(greatest(c / nc, 1e-6) / greatest(r / nr, 1e-6))) as psi from ct group by feature),
  cx as (select feature, max(k) as k, sum(power(r - (r + c) * nr / (nr + nc), 2) / ((r + c) * nr / (nr + nc)) + power(c - (r + c) * nc / (nr + nc), 2) / ((r + c) * nc / (nr + nc))) as x from ct group by feature)"""


@case("d3_psi_categorical", f"with {cats_sql(CAT)} select * from cp", r6="psi")
def _(t: Tables):
    return D.psi_categorical(*loan_sides(t), CAT)


KS = """kv as (select feature, value, count(case when side = 'ref' then 1 end) as r, count(case when side = 'cur' then 1 end) as c from lg group by 1, 2),
  kr as (select *, sum(r) over w / cast(sum(r) over (partition by feature) as double) as fr, sum(c) over w / cast(sum(c) over (partition by feature) as double) as fc,
    lead(value) over w as nxt from kv window w as (partition by feature order by value)),
  kn as (select feature, cast(sum(r) as double) as n1, cast(sum(c) as double) as n2 from kv group by feature),
  kd as (select kr.feature, max(abs(fr - fc)) as ks_statistic, sum(abs(fr - fc) * coalesce(nxt - value, 0)) as wasserstein, max(n1) as n1, max(n2) as n2
    from kr join kn on kn.feature = kr.feature group by kr.feature),
  kp as (select *, sqrt(n1 * n2 / (n1 + n2)) * ks_statistic as lam from kd),
  kq as (select feature, ks_statistic, wasserstein, case when lam < 2e-1 then 1e0 else greatest(least(list_sum(list_transform(range(1, 101),
    lambda k: case when k % 2 = 1 then 2e0 else -2e0 end * exp(-2e0 * k * k * lam * lam))), 1e0), 0e0) end as ks_p_value from kp)"""


@case("d4_ks_2samp", f"with {long_sql(NUM)}, {KS} select feature, ks_statistic, ks_p_value from kq", r6="ks_statistic ks_p_value")
def _(t: Tables):
    return D.ks_2samp(*loan_sides(t), NUM)


# risk_grade has 5 categories: the tail for 4 degrees of freedom has a closed form.
@case(
    "d5_chi2",
    f"with {cats_sql(('risk_grade',))} select feature, x as chi2_statistic, k as n_categories, exp(-x / 2) * (1 + x / 2) as chi2_p_value from cx",
    r6="chi2_statistic chi2_p_value",
)
def _(t: Tables):
    return D.chi2(*loan_sides(t), ("risk_grade",))


@case(
    "d5_chi2_statistics",
    f"with {cats_sql(CAT)} select feature, x as chi2_statistic, k as n_categories from cx",
    r6="chi2_statistic",
)
def _(t: Tables):
    return D.chi2(*loan_sides(t), CAT).drop("chi2_p_value")


MOMENTS = """mo as (select feature, avg(case when side = 'ref' then value end) as ref_mean, avg(case when side = 'cur' then value end) as cur_mean,
  stddev_pop(case when side = 'ref' then value end) as ref_std, stddev_pop(case when side = 'cur' then value end) as cur_std from lg group by feature)"""


@case("d6_moments", f"with {long_sql(NUM)}, {MOMENTS} select * from mo", r4="ref_mean cur_mean ref_std cur_std")
def _(t: Tables):
    return D.moments(D.both_sides(*loan_sides(t), NUM))


DRIFT_ROWS = f"""{long_sql(NUM)}, {hist_sql(10)}, ps as ({PSI}), {KS}, {MOMENTS}, {cats_sql(('risk_grade',))},
  dr as (select ps.feature, 'numeric' as kind, psi, ks_statistic as statistic, ks_p_value as p_value, ref_mean, cur_mean, ref_std, cur_std
      from ps join kq on kq.feature = ps.feature join mo on mo.feature = ps.feature
    union all select cp.feature, 'categorical', psi, x, exp(-x / 2) * (1 + x / 2), null, null, null, null from cp join cx on cx.feature = cp.feature),
  dd as (select *, case when psi >= 2e-1 then 'significant' when psi >= 1e-1 then 'moderate' else 'stable' end as classification,
    psi >= 1e-1 or p_value < 5e-2 as drifted from dr)"""


@case("d7_data_drift", f"with {DRIFT_ROWS} select * from dd", r6="psi statistic p_value", r4="ref_mean cur_mean ref_std cur_std")
def _(t: Tables):
    return D.data_drift(*loan_sides(t), NUM, ("risk_grade",))


@case(
    "d7_data_drift_summary",
    f"""with {DRIFT_ROWS} select count(case when drifted then 1 end) as n_drifted, count(*) as n_features,
      count(case when drifted then 1 end) / cast(count(*) as double) as drift_fraction, count(case when drifted then 1 end) > 0 as overall_drift_detected from dd""",
    r6="drift_fraction",
)
def _(t: Tables):
    return D.data_drift_summary(D.data_drift(*loan_sides(t), NUM, ("risk_grade",)))


BRANDS = "select l_shipdate, p_brand, p_type from lineitem join part on l_partkey = p_partkey"


@case(
    "d8_category_changes",
    """with b as (select l_shipdate < timestamp '1993-01-01 00:00:00' as old, cast(l_quantity as int) as q, l_returnflag as f, p_type || '-' || cast(p_size as varchar) as kind
      from lineitem join part on l_partkey = p_partkey where p_size < 40 or l_shipdate >= timestamp '1993-01-01 00:00:00')
    select 'kind' as feature, kind as value, case when sum(case when old then 1 else 0 end) = 0 then 'new' else 'removed' end as change
    from b group by kind having sum(case when old then 1 else 0 end) = 0 or sum(case when old then 0 else 1 end) = 0""",
)
def _(t: Tables):
    b = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_shipdate", "p_size", F.concat_ws("-", "p_type", F.col("p_size").cast("string")).alias("kind")
    )
    old = F.col("l_shipdate") < F.lit("1993-01-01 00:00:00").cast("timestamp_ntz")
    return D.category_changes(b.where(old & (F.col("p_size") < 40)), b.where(~old), ["kind"])


@case(
    "d9_batch_drift",
    f"""with {long_sql(NUM)}, {hist_sql(10, True)}, n as ({COMBINED}), {cats_sql(CAT)},
    a as (select feature, psi, drift_detected, severity from n union all
      select feature, null, max(case when r = 0 or c = 0 then 1 else 0 end) = 1, case when max(case when r = 0 or c = 0 then 1 else 0 end) = 1 then 'moderate' else 'low' end from cc group by feature)
    select *, count(case when drift_detected then 1 end) over () > count(*) over () * 5e-2 as overall_drift from a""",
    r6="psi",
)
def _(t: Tables):
    ref, cur = loan_sides(t)
    cols = [*NUM, *CAT]
    return D.batch_drift(ref.select(*cols), cur.select(*cols))


ERR = "er as (select *, abs(label - pred) as err, seq + 1 as n from errors), nr as (select count(case when side = 'ref' then 1 end) as n_ref, count(*) as n_all, avg(err) as mean from er)"


@case(
    "d10_page_hinkley",
    f"""with {ERR}, s as (select seq, sum(err - mean - 5e-3) over (order by seq) as s from er cross join nr),
    m as (select seq, s, s - min(s) over (order by seq) > 5e1 as hit from s),
    h as (select min(case when hit then seq end) as p from m)
    select coalesce(p >= n_ref, false) as drift_detected, p as drift_point,
      (select s from m where seq = coalesce(p, n_all - 1)) as page_hinkley_statistic, 5e1 as threshold from h, nr""",
    r6="page_hinkley_statistic",
)
def _(t: Tables):
    return D.page_hinkley(t.errors)


@case(
    "d11_ddm",
    f"""with {ERR}, a as (select seq, n, sum(case when (case when pred >= 5e-1 then 1 else 0 end) <> label then 1 else 0 end) over (order by seq) / cast(n as double) as p from er),
    b as (select *, sqrt(p * (1 - p) / n) as s from a),
    c as (select b.*, first_value(p) over w as unused, n > greatest(n_ref, 30) as counted from b cross join nr window w as (order by seq)),
    d as (select *, min(case when counted then (p + s) end) over (order by seq) as low from c),
    e as (select d.*, (select min(x.seq) from d x where x.counted and x.p + x.s = d.low) as at from d),
    f as (select e.*, l.p as pm, l.s as sm from e left join b l on l.seq = e.at),
    h as (select min(case when p + s > pm + 3 * sm then seq end) as drift_point from f),
    w as (select min(case when p + s > pm + 2 * sm and (drift_point is null or seq <> drift_point) then seq end) as warning_point from f cross join h)
    select coalesce(drift_point >= n_ref, false) as drift_detected, coalesce(warning_point >= n_ref, false) as warning_detected, drift_point, warning_point,
      (select p from f order by seq desc limit 1) as final_error_rate, (select pm from f order by seq desc limit 1) as min_error_rate from h, w, nr""",
    r6="final_error_rate min_error_rate",
)
def _(t: Tables):
    return D.ddm(t.errors)


@case(
    "d12_adwin_like",
    f"""with {ERR}, c as (select seq, n, n // 2 as half, sum(err) over (order by seq) as s from er),
    j as (select c.seq, c.half, c.n, l.s / c.half as lm, (c.s - l.s) / (c.n - c.half) as rm from c join c l on l.seq = c.half - 1 where c.half >= 30 and c.seq >= 30),
    k as (select j.*, abs(lm - rm) >= sqrt((1 / (2e0 * half) + 1 / (2e0 * (n - half))) * 2 * ln(2e0 * n_all / 2e-3)) as hit from j cross join nr),
    f as (select * from k where hit order by seq limit 1)
    select coalesce(f.seq >= n_ref, false) as drift_detected, f.seq as drift_point, coalesce(f.n - f.half, n_all) as window_size, coalesce(f.rm, mean) as mean_error from nr left join f on true""",
    r6="mean_error",
)
def _(t: Tables):
    return D.adwin_like(t.errors)


SEGS = f"""bo as (select [{", ".join(f"quantile_cont(pred, {q})" for q in (0, 0.25, 0.5, 0.75, 1))}] as b from errors where side = 'ref'),
  sg as (select side, label as y, pred as p, 'quantile_' || cast(i as varchar) as segment, b[i] as lo, b[i + 1] as hi from errors cross join bo cross join (select unnest([1, 2, 3, 4]) as i) g
    where pred >= b[i] and pred <= b[i + 1]),
  sk as (select *, segment || '|' || side as sid from sg), {rank_sql('sk', 'sid')},
  ss as (select sk.segment, sk.side, min(lo) as lo, min(hi) as hi, count(*) as n, sum(y) as pos, count(*) - sum(y) as neg, max(sid) as sid from sk group by 1, 2),
  sa as (select ss.*, auc_roc from ss join au on au.sid = ss.sid where n >= 5 and pos > 0 and neg > 0)"""


@case(
    "d13_segment_degradation",
    f"""with {SEGS} select a.segment, a.lo, a.hi, a.auc_roc as reference_auc, b.auc_roc as current_auc, a.auc_roc - b.auc_roc as degradation,
      a.auc_roc - b.auc_roc > 5e-2 as significantly_degraded from sa a join sa b on a.segment = b.segment where a.side = 'ref' and b.side = 'cur'""",
    r6="lo hi reference_auc current_auc degradation",
)
def _(t: Tables):
    return D.segment_degradation(t.errors)


PERF = f"""pe as (select side, label as y, pred as p from errors), {rank_sql('pe', 'side')}, pc as (select side, {COUNT_SQL}, {LOSSES} from pe group by side),
  pm as (select pc.*, {RATES}, auc_roc from pc join au on au.side = pc.side)"""


@case(
    "d14_concept_drift",
    f"""with {PERF} select a.auc_roc as ref_auc_roc, a.f1_score as ref_f1_score, a.brier_score as ref_brier_score, a.total_samples as ref_total_samples,
      b.auc_roc as cur_auc_roc, b.f1_score as cur_f1_score, b.brier_score as cur_brier_score, b.total_samples as cur_total_samples,
      a.auc_roc - b.auc_roc as auc_degradation, a.f1_score - b.f1_score as f1_degradation, b.brier_score - a.brier_score as loss_increase
    from pm a, pm b where a.side = 'ref' and b.side = 'cur'""",
    r6="ref_auc_roc ref_f1_score ref_brier_score cur_auc_roc cur_f1_score cur_brier_score auc_degradation f1_degradation loss_increase",
)
def _(t: Tables):
    return D.concept_drift(t.errors).drop(
        "page_hinkley_drift", "ddm_drift", "adwin_like_drift", "signals", "drift_detected", "severity", "drift_type"
    )


@case("d14_concept_drift_decision")
def _(t: Tables):
    return D.concept_drift(t.errors).select(
        "page_hinkley_drift", "ddm_drift", "adwin_like_drift", "signals", "drift_detected", "severity", "drift_type"
    )


@case("d15_wasserstein", f"with {long_sql(NUM)}, {KS} select feature, wasserstein from kq", r4="wasserstein")
def _(t: Tables):
    return D.wasserstein(*loan_sides(t), NUM)


DIV = """dn as (select *, greatest(rs / width, 1e-10) as rd, greatest(cs / width, 1e-10) as cd from sh),
  dq as (select *, rd / sum(rd) over (partition by feature) as pp, cd / sum(cd) over (partition by feature) as qq from dn),
  dv as (select feature, sum((case when rs > 0 then rs * ln(rs / ((rs + cs) / 2)) else 0 end + case when cs > 0 then cs * ln(cs / ((rs + cs) / 2)) else 0 end) / 2) as js_divergence,
    sum(pp * ln(pp / qq)) as kl_divergence from dq group by feature)"""


@case("d16_js_divergence", f"with {long_sql(NUM)}, {hist_sql(20)}, {DIV} select feature, js_divergence from dv", r6="js_divergence")
def _(t: Tables):
    return D.js_divergence(*loan_sides(t), NUM)


@case("d17_kl_divergence", f"with {long_sql(NUM)}, {hist_sql(20)}, {DIV} select feature, kl_divergence from dv", r6="kl_divergence")
def _(t: Tables):
    return D.kl_divergence(*loan_sides(t), NUM)


SCORE_LG = "lg as (select case when loan_id % 3 = 0 then 'cur' else 'ref' end as side, 'p' as feature, case when loan_id % 3 = 0 then sqrt(p) else p end as value from scored)"


@case(
    "d18_prediction_drift",
    f"""with {SCORE_LG}, {KS}, {MOMENTS}, {hist_sql(20)}, {DIV},
    r as (select ks_statistic, ks_p_value, ks_p_value < 5e-2 as ks_drift, wasserstein, case when wasserstein > 1e-1 then 'significant' when wasserstein > 5e-2 then 'moderate' else 'stable' end as wasserstein_class,
      js_divergence, case when js_divergence > 5e-2 then 'significant' when js_divergence > 1e-2 then 'moderate' else 'stable' end as js_class, kl_divergence, ref_mean, cur_mean, ref_std, cur_std
      from kq, dv, mo),
    h as (select *, cast(ks_drift as int) + cast(wasserstein_class = 'significant' as int) + cast(js_class = 'significant' as int) as hits from r)
    select * exclude (hits), hits >= 2 as overall_drift_detected, case when hits >= 3 then 'high' when hits >= 2 then 'moderate' when hits >= 1 then 'low' else 'none' end as severity from h""",
    r6="ks_statistic ks_p_value wasserstein js_divergence kl_divergence ref_mean cur_mean ref_std cur_std",
)
def _(t: Tables):
    s = t.scored
    cur = s.where("loan_id % 3 = 0").select(F.sqrt("p").alias("p"))
    return D.prediction_drift(s.where("loan_id % 3 <> 0"), cur)


IMP = """im as (select feature, reference_importance / sum(reference_importance) over () as rs, current_importance / sum(current_importance) over () as cs from importances),
  id as (select feature, round(rs, 6) as reference_importance, round(cs, 6) as current_importance, round(abs(cs - rs), 6) as absolute_change,
    round(case when rs > 1e-8 then abs(cs - rs) / rs else 0e0 end, 6) as relative_change,
    row_number() over (order by rs desc, feature) as reference_rank, row_number() over (order by cs desc, feature) as current_rank from im)"""
IMP_COLS = "reference_importance current_importance absolute_change relative_change"


@case(
    "d19_importance_drift",
    f"""with {IMP}, x as (select *, reference_rank - current_rank as rank_change, row_number() over (order by absolute_change desc, feature) as change_position from id)
    select * replace (cast(reference_rank as int) as reference_rank, cast(current_rank as int) as current_rank, cast(rank_change as int) as rank_change, cast(change_position as int) as change_position)
    from x where change_position <= 10""",
    r4=IMP_COLS,
)
def _(t: Tables):
    return D.top_changes(D.importance_drift(t.importances))


RANKS = """rk as (select (count(*) over (order by x)) - (count(*) over (partition by x) - 1) / 2e0 as rx, (count(*) over (order by y)) - (count(*) over (partition by y) - 1) / 2e0 as ry from xy)"""


@case(
    "d20_spearman",
    f"with xy as (select loan_amount as x, debt_to_income + loan_amount / 1e6 as y from loans), {RANKS} select corr(rx, ry) as statistic, count(*) as n from rk",
    r6="statistic",
)
def _(t: Tables):
    df = t.loans.select(
        F.col("loan_amount").alias("x"), (F.col("debt_to_income") + F.col("loan_amount") / 1e6).alias("y")
    )
    return D.spearman(df, "x", "y").select("statistic", "n")


@case(
    "d20_importance_summary",
    f"""with {IMP}, xy as (select reference_importance as x, current_importance as y from importances), {RANKS}
    select count(*) as n_features, max(absolute_change) as max_absolute_change, avg(absolute_change) as mean_absolute_change,
      max(absolute_change) > 1e-1 as importance_drift_detected, (select corr(rx, ry) from rk) as spearman from id""",
    r4="max_absolute_change mean_absolute_change spearman",
)
def _(t: Tables):
    return D.importance_summary(D.importance_drift(t.importances), t.importances)


def _report(t: Tables):
    s = t.scored
    return D.drift_report(
        D.data_drift(*loan_sides(t), NUM, ("risk_grade",)),
        D.concept_drift(t.errors),
        D.prediction_drift(s.where("loan_id % 3 <> 0"), s.where("loan_id % 3 = 0").select(F.sqrt("p").alias("p"))),
        D.importance_drift(t.importances),
    )


@case("d21_drift_report")
def _(t: Tables):
    return _report(t)


@case("d22_retrain_decision")
def _(t: Tables):
    return D.retrain_decision(_report(t))


@case(
    "d23_retrain_check",
    """with l as (select *, case when months_since_issue <= 12 and loan_status in ('Charged Off', 'Default', 'Late (16-30 days)', 'Late (31-120 days)', 'In Grace Period') then 1 else 0 end as y from loans),
    a as (select count(*) as n_reference, avg(y) as reference_rate from l where months_since_issue > 6), b as (select count(*) as n_current, avg(y) as current_rate from l where months_since_issue <= 36)
    select n_reference, n_current, reference_rate, current_rate, true as retrain_needed,
      case when n_current / cast(n_reference as double) > 5e-1 and abs(reference_rate - current_rate) > 1e-1 then 'target_rate_drift; model_age=45_days' else 'model_age=45_days' end as reasons from a, b""",
    r6="reference_rate current_rate",
)
def _(t: Tables):
    from riskloom.operators.loan import default_label

    l = default_label(t.loans, out="y")
    return D.retrain_check(l.where("months_since_issue > 6"), l.where("months_since_issue <= 36"), "y", model_age_days=45)


@case(
    "d24_better_model",
    f"""with m as (select 'old' as model, y, p from scored union all select 'new', y, case when loan_id % 5 = 0 then 1 - p else p end from scored), {rank_sql('m', 'model')},
    c as (select model, {COUNT_SQL} from m group by model), w as (select c.*, {RATES}, auc_roc from c join au on au.model = c.model)
    select o.auc_roc as old_auc, n.auc_roc as new_auc, o.f1_score as old_f1, n.f1_score as new_f1,
      n.auc_roc > o.auc_roc or (abs(n.auc_roc - o.auc_roc) < 1e-3 and n.f1_score > o.f1_score) as new_is_better from w o, w n where o.model = 'old' and n.model = 'new'""",
    r6="old_auc new_auc old_f1 new_f1",
)
def _(t: Tables):
    df = t.scored.withColumn("p2", F.when(F.col("loan_id") % 5 == 0, 1 - F.col("p")).otherwise(F.col("p")))
    return D.better_model(df, "p", "p2")
