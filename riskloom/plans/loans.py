"""Label, cleaning, encoding, splitting and loan features on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import loan as L
from riskloom.operators import prep as P
from riskloom.plans.registry import case
from riskloom.plans.tables import Tables

STATUSES = ", ".join(f"'{s}'" for s in L.DEFAULT_STATUSES)
LABEL = f"case when months_since_issue <= 12 and loan_status in ({STATUSES}) then 1 else 0 end"


@case("c1_default_label", f"select loan_id, {LABEL} as default_status from loans")
def _(t: Tables):
    return L.default_label(t.loans).select("loan_id", "default_status")


@case(
    "c2_merge_text",
    """select l.loan_id, l.loan_amount, l.loan_type, d.lang, d.source as loan_type_text, d.n_chars
    from loans l left join documents d on l.loan_id = d.doc_id""",
)
def _(t: Tables):
    text = t.documents.select(F.col("doc_id").alias("loan_id"), "lang", F.col("source").alias("loan_type"), "n_chars")
    return P.merge_text(t.loans.select("loan_id", "loan_amount", "loan_type"), text)


HOLES = """select loan_id, case when loan_id % 7 = 0 then null else loan_amount end as loan_amount,
  case when loan_id % 11 = 0 then null else debt_to_income end as debt_to_income,
  case when loan_id % 5 = 0 then null else loan_type end as loan_type,
  case when loan_id % 3 = 0 then null else risk_grade end as risk_grade from loans"""


@case(
    "c3_impute_median",
    f"""with h as ({HOLES}), m as (select median(loan_amount) as a, median(debt_to_income) as d from h)
    select loan_id, coalesce(loan_amount, m.a) as loan_amount, coalesce(debt_to_income, m.d) as debt_to_income
    from h, m""",
    r4="loan_amount",
    r6="debt_to_income",
)
def _(t: Tables):
    df = t.sql(HOLES).select("loan_id", "loan_amount", "debt_to_income")
    return P.impute_median(df, ["loan_amount", "debt_to_income"])


@case(
    "c4_impute_constant",
    f"select loan_id, coalesce(loan_type, 'Unknown') as loan_type, coalesce(risk_grade, 'Unknown') as risk_grade from ({HOLES}) h",
)
def _(t: Tables):
    return P.impute_constant(t.sql(HOLES).select("loan_id", "loan_type", "risk_grade"))


@case(
    "c5_clip_iqr",
    """with x as (select loan_id, loan_amount * loan_amount / 1e6 as loan_amount, case when loan_id % 97 = 0 then 1e3 else debt_to_income end as debt_to_income from loans),
    q as (select quantile_cont(loan_amount, 0.25) as a1, quantile_cont(loan_amount, 0.75) as a3,
      quantile_cont(debt_to_income, 0.25) as d1, quantile_cont(debt_to_income, 0.75) as d3 from x)
    select loan_id, greatest(least(loan_amount, a3 + 3 * (a3 - a1)), a1 - 3 * (a3 - a1)) as loan_amount,
      greatest(least(debt_to_income, d3 + 3 * (d3 - d1)), d1 - 3 * (d3 - d1)) as debt_to_income from x, q""",
    r4="loan_amount",
    r6="debt_to_income",
)
def _(t: Tables):
    df = t.loans.select(
        "loan_id",
        (F.col("loan_amount") * F.col("loan_amount") / 1e6).alias("loan_amount"),
        F.when(F.col("loan_id") % 97 == 0, F.lit(1e3)).otherwise(F.col("debt_to_income")).alias("debt_to_income"),
    )
    return P.clip_iqr(df, ["loan_amount", "debt_to_income"])


def _codes(col: str) -> str:
    return f"(select {col}, cast(dense_rank() over (order by {col}) - 1 as int) as code from (select distinct {col} from loans) v)"


@case(
    "c6_label_encode",
    f"""select l.loan_id, a.code as loan_type, b.code as borrower_segment, c.code as loan_status
    from loans l join {_codes('loan_type')} a on l.loan_type = a.loan_type
    join {_codes('borrower_segment')} b on l.borrower_segment = b.borrower_segment
    join {_codes('loan_status')} c on l.loan_status = c.loan_status""",
)
def _(t: Tables):
    cols = ["loan_type", "borrower_segment", "loan_status"]
    return P.label_encode(t.loans.select("loan_id", *cols), cols)


@case(
    "c7_ordinal_encode",
    """select l.loan_id, coalesce(a.code, -1) as loan_type from loans l left join
    (select loan_type, cast(dense_rank() over (order by loan_type) - 1 as int) as code from
      (select distinct loan_type from loans where loan_type not in ('auto', 'student')) v) a on l.loan_type = a.loan_type""",
)
def _(t: Tables):
    train = t.loans.where(~F.col("loan_type").isin("auto", "student"))
    return P.ordinal_encode(train, t.loans.select("loan_id", "loan_type"), ["loan_type"])


@case(
    "c8_standard_scale",
    """with s as (select avg(loan_amount) as ma, stddev_pop(loan_amount) as sa, avg(credit_score) as mc, stddev_pop(credit_score) as sc from loans)
    select loan_id, (loan_amount - ma) / sa as loan_amount, (credit_score - mc) / sc as credit_score from loans, s""",
    r6="loan_amount credit_score",
)
def _(t: Tables):
    return P.standard_scale(t.loans.select("loan_id", "loan_amount", "credit_score"), ["loan_amount", "credit_score"])


@case("c9_power_transform")
def _(t: Tables):
    return P.power_transform(t.loans.select("loan_id", "loan_amount", "annual_income"), ["loan_amount", "annual_income"])


@case(
    "c10_date_parts",
    """select loan_id, cast(extract(year from issue_date) as int) as issue_date_year, cast(extract(month from issue_date) as int) as issue_date_month,
      cast(extract(day from issue_date) as int) as issue_date_day, cast(extract(isodow from issue_date) - 1 as int) as issue_date_dayofweek from loans""",
)
def _(t: Tables):
    return P.date_parts(t.loans.select("loan_id", "issue_date"))


@case(
    "c11_preprocess",
    f"""with h as (select * from ({HOLES}) z), m as (select median(loan_amount) as a, median(debt_to_income) as d from h),
    f as (select loan_id, coalesce(loan_amount, m.a) as loan_amount, coalesce(debt_to_income, m.d) as debt_to_income,
      coalesce(loan_type, 'Unknown') as loan_type, coalesce(risk_grade, 'Unknown') as risk_grade from h, m),
    q as (select quantile_cont(loan_amount, 0.25) as a1, quantile_cont(loan_amount, 0.75) as a3,
      quantile_cont(debt_to_income, 0.25) as d1, quantile_cont(debt_to_income, 0.75) as d3 from f),
    lt as (select loan_type, cast(dense_rank() over (order by loan_type) - 1 as int) as code from (select distinct loan_type from f) v),
    rg as (select risk_grade, cast(dense_rank() over (order by risk_grade) - 1 as int) as code from (select distinct risk_grade from f) v)
    select f.loan_id, greatest(least(loan_amount, a3 + 3 * (a3 - a1)), a1 - 3 * (a3 - a1)) as loan_amount,
      greatest(least(debt_to_income, d3 + 3 * (d3 - d1)), d1 - 3 * (d3 - d1)) as debt_to_income,
      lt.code as loan_type, rg.code as risk_grade
    from f join lt on f.loan_type = lt.loan_type join rg on f.risk_grade = rg.risk_grade cross join q""",
    r4="loan_amount",
    r6="debt_to_income",
)
def _(t: Tables):
    return P.Preprocessor().fit_transform(t.sql(HOLES))


@case("c12_stratified_split")
def _(t: Tables):
    labelled = L.default_label(t.loans).select("loan_id", "default_status")
    parts = P.stratified_split(labelled, "default_status", "loan_id")
    return parts.groupBy("part", "default_status").agg(F.count(F.lit(1)).alias("n"))


@case(
    "c13_kfold",
    f"""with l as (select {LABEL} as default_status from loans),
    r as (select default_status, cast((row_number() over (partition by default_status) - 1) % 5 as int) as fold from l)
    select fold, default_status, count(*) as n from r group by fold, default_status""",
)
def _(t: Tables):
    folds = P.kfold(L.default_label(t.loans).select("loan_id", "default_status"), "loan_id", y="default_status")
    return folds.groupBy("fold", "default_status").agg(F.count(F.lit(1)).alias("n"))


@case(
    "c14_replace_nonfinite",
    """select loan_id, case when loan_id % 5 in (0, 1, 2) then 0e0 else loan_amount end as x,
      coalesce(case when loan_id % 7 = 0 then null else credit_score end, 0) as s from loans""",
)
def _(t: Tables):
    k = F.col("loan_id") % 5
    df = t.loans.select(
        "loan_id",
        F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).when(k != 2, F.col("loan_amount")).alias("x"),
        F.when(F.col("loan_id") % 7 != 0, F.col("credit_score")).alias("s"),
    )
    return P.replace_nonfinite(df, skip=["loan_id"])


@case("c15_oversample")
def _(t: Tables):
    df = L.default_label(t.loans).select("loan_id", "default_status", "credit_score", "debt_to_income")
    more = P.oversample(df, "default_status", "loan_id", ["credit_score", "debt_to_income"], ratio=0.5)
    return more.groupBy("default_status", "synthetic").agg(
        F.count(F.lit(1)).alias("n"), F.avg("debt_to_income").alias("mean_dti")
    )


COMPLETE = "credit_score is not null and not isnan(credit_score::double) and debt_to_income is not null and not isnan(debt_to_income::double) and loan_id is not null"


@case(
    "c15_oversample_counts",
    f"""with l as (select loan_id, {LABEL} as y, credit_score, debt_to_income from loans),
    s as (select y, count(*) as n, count(*) filter (where {COMPLETE}) as n_full from l where y is not null group by y),
    lo as (select * from s order by n, y limit 1),
    hi as (select * from s order by n desc, y limit 1),
    m as (select lo.y, lo.n_full, floor(0.5 * hi.n)::bigint - lo.n as missing from lo, hi),
    c as (
      select m.y, m.missing // m.n_full + case when
        ((l.loan_id % 4294967296 + 4294967296) % 4294967296 * 1540483477 % 4294967296) / 4294967296e0 < (m.missing % m.n_full) / m.n_full::double
        then 1 else 0 end as copies
      from m join l on l.y = m.y and {COMPLETE} where m.missing > 0
    )
    select y as default_status, false as synthetic, count(*) as n from l group by y
    union all
    select y, true, sum(copies) as n from c group by y having sum(copies) > 0""",
)
def _(t: Tables):
    df = L.default_label(t.loans).select("loan_id", "default_status", "credit_score", "debt_to_income")
    more = P.oversample(df, "default_status", "loan_id", ["credit_score", "debt_to_income"], ratio=0.5)
    return more.groupBy("default_status", "synthetic").agg(F.count(F.lit(1)).alias("n"))


@case(
    "c16_class_weights",
    f"""with l as (select loan_id, {LABEL} as y from loans), n as (select y, count(*) as c from l group by y)
    select l.loan_id, l.y, (select count(*) from l) / (2e0 * n.c) as weight from l join n on l.y = n.y""",
    r6="weight",
)
def _(t: Tables):
    df = L.default_label(t.loans, out="y").select("loan_id", "y")
    return P.class_weights(df, "y")


def pos(n: str, d: str) -> str:
    return f"case when {d} > 0 then ({n}) / cast({d} as double) else 0e0 end"


F1 = f"""{pos('loan_amount', 'annual_income')} as loan_to_income, {pos('installment_amount * 12', 'annual_income')} as installment_to_income,
  {pos('total_revolving_bal', 'total_revolving_credit_limit')} as revolving_utilization,
  {pos('total_current_balance', 'total_revolving_credit_limit')} as balance_to_credit_limit,
  {pos('annual_income', 'total_acc')} as income_per_account, debt_to_income * total_credit_utilization as debt_burden_score,
  {pos('total_acc', 'open_credit_lines')} as credit_efficiency"""
F1_COLS = "loan_to_income installment_to_income revolving_utilization balance_to_credit_limit income_per_account debt_burden_score credit_efficiency"


@case("f1_financial_ratios", f"select loan_id, {F1} from loans", r6=F1_COLS)
def _(t: Tables):
    return L.financial_ratios(t.loans).select("loan_id", *F1_COLS.split())


FLAG_TESTS = (
    "debt_to_income > 43e-2", "credit_score < 620", "total_credit_utilization > 75e-2", "months_since_first_credit_line < 24",
    "delinquency_2yrs > 2", "months_since_last_delinquency < 6", "num_collections_12m > 0", "num_derogatory_records > 1",
    "employment_length <= 1",
)
F2 = ", ".join(f"case when {c} then 1 else 0 end as {n}" for c, n in zip(FLAG_TESTS, L.RISK_FLAGS))
F2_SUM = " + ".join(f"(case when {c} then 1 else 0 end)" for c in FLAG_TESTS)


@case("f2_risk_indicators", f"select loan_id, {F2}, {F2_SUM} as risk_score_sum from loans")
def _(t: Tables):
    return L.risk_indicators(t.loans).select("loan_id", *L.RISK_FLAGS, "risk_score_sum")


F3 = f"""credit_score * annual_income as credit_x_income, debt_to_income * total_credit_utilization as dti_x_utilization,
  loan_amount * interest_rate as loan_x_interest, employment_length * annual_income as income_stability,
  {pos('credit_score', 'months_since_last_delinquency')} as credit_momentum,
  case when debt_to_income > 0 then annual_income * (1 - debt_to_income) else 0e0 end as debt_capacity"""
F3_COLS = "credit_x_income dti_x_utilization loan_x_interest income_stability credit_momentum debt_capacity"


@case("f3_interactions", f"select loan_id, {F3} from loans", r4=F3_COLS)
def _(t: Tables):
    return L.interactions(t.loans).select("loan_id", *F3_COLS.split())


def bucket_sql(x: str, edges) -> str:
    whens = " ".join(f"when {x} > {lo} and {x} <= {hi} then {i}e0" for i, (lo, hi) in enumerate(zip(edges, edges[1:])))
    return f"case {whens} end"


F4 = f"""months_since_issue as loan_age, {bucket_sql('months_since_issue', L.LOAN_AGE_EDGES)} as loan_age_bucket,
  months_since_first_credit_line as credit_history_length,
  {bucket_sql('months_since_first_credit_line', L.HISTORY_EDGES)} as credit_history_bucket"""
F4_COLS = "loan_age loan_age_bucket credit_history_length credit_history_bucket"


@case("f4_temporal_buckets", f"select loan_id, {F4} from loans")
def _(t: Tables):
    return L.temporal_buckets(t.loans).select("loan_id", *F4_COLS.split())


def group_sql(key: str, prefix: str) -> str:
    aggs = ", ".join(
        f"avg({c}) as {prefix}{c}_mean, stddev_samp({c}) as {prefix}{c}_std, median(cast({c} as double)) as {prefix}{c}_median"
        for c in L.GROUP_COLUMNS
    )
    return f"(select {key}, {aggs} from loans group by {key})"


F5_COLS = " ".join(f"{p}{c}_{s}" for p in L.GROUP_PREFIXES.values() for c in L.GROUP_COLUMNS for s in ("mean", "std", "median"))
F5_JOIN = " ".join(f"left join {group_sql(k, p)} {p}g on l.{k} = {p}g.{k}" for k, p in L.GROUP_PREFIXES.items())


@case("f5_group_stats", f"select loan_id, {F5_COLS.replace(' ', ', ')} from loans l {F5_JOIN}", r4=F5_COLS)
def _(t: Tables):
    return L.group_stats(t.loans).select("loan_id", *F5_COLS.split())


@case(
    "f6_polynomial",
    """select loan_id, cast(credit_score * credit_score as double) as "poly_credit_score^2", credit_score * debt_to_income as "poly_credit_score debt_to_income",
      credit_score * total_credit_utilization as "poly_credit_score total_credit_utilization", debt_to_income * debt_to_income as "poly_debt_to_income^2",
      debt_to_income * total_credit_utilization as "poly_debt_to_income total_credit_utilization",
      total_credit_utilization * total_credit_utilization as "poly_total_credit_utilization^2" from loans""",
)
def _(t: Tables):
    cols = ["credit_score", "debt_to_income", "total_credit_utilization"]
    wide = L.polynomial(t.loans.select("loan_id", *cols), cols)
    return wide.drop(*cols)


F7 = f"""case when loan_type = 'mortgage' then {pos('loan_amount', 'annual_income * 4')} end as home_equity_ratio,
  case when loan_type = 'auto' then {pos('installment_amount * 12', 'annual_income')} end as auto_loan_burden,
  case when loan_type = 'business' then debt_to_income * (1 + delinquency_2yrs) end as business_risk_score"""
F7_COLS = "home_equity_ratio auto_loan_burden business_risk_score"


@case("f7_loan_type_features", f"select loan_id, {F7} from loans", r6=F7_COLS)
def _(t: Tables):
    return L.loan_type_features(t.loans).select("loan_id", *F7_COLS.split())


F8_COLS = " ".join([F1_COLS, F3_COLS, F7_COLS, F5_COLS, "loan_age_bucket", "credit_history_bucket"])
F8_R6 = " ".join([F1_COLS, F7_COLS])
F8_R4 = " ".join([F3_COLS, F5_COLS])


@case(
    "f8_loan_features",
    f"""with w as (select loan_id, loan_type, borrower_segment, risk_grade, {F1}, {F2_SUM} as risk_score_sum, {F3}, {F4}, {F7} from loans)
    select loan_id, risk_score_sum, {", ".join(f"coalesce({c}, 0) as {c}" for c in F8_COLS.split())} from w l {F5_JOIN}""",
    r6=F8_R6,
    r4=F8_R4,
)
def _(t: Tables):
    return L.loan_features(t.loans).select("loan_id", "risk_score_sum", *F8_COLS.split())


F9_COLS = "loan_to_income debt_burden_score high_dti low_credit_score high_utilization risk_score_sum"
F9 = """loan_amount / greatest(annual_income, 1e0) as loan_to_income, debt_to_income * total_credit_utilization as debt_burden_score,
  case when debt_to_income > 43e-2 then 1 else 0 end as high_dti, case when credit_score < 620 then 1 else 0 end as low_credit_score,
  case when total_credit_utilization > 75e-2 then 1 else 0 end as high_utilization,
  (case when debt_to_income > 43e-2 then 1 else 0 end) + (case when credit_score < 620 then 1 else 0 end)
    + (case when total_credit_utilization > 75e-2 then 1 else 0 end) + (case when num_collections_12m > 0 then 1 else 0 end)
    + (case when num_derogatory_records > 1 then 1 else 0 end) as risk_score_sum"""


@case("f9_serving_features", f"select loan_id, {F9} from loans", r6="loan_to_income debt_burden_score")
def _(t: Tables):
    return L.serving_features(t.loans).select("loan_id", *F9_COLS.split())


@case(
    "f10_align_columns",
    "select loan_id, cast(credit_score as double) as credit_score, 0e0 as unknown_feature, debt_to_income from loans",
)
def _(t: Tables):
    return L.align_columns(t.loans, ["credit_score", "unknown_feature", "debt_to_income"], keep=["loan_id"])
