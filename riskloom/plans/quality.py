"""Rules, profiles and run tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import quality as V
from riskloom.operators import runs as M
from riskloom.operators.loan import default_label
from riskloom.plans.registry import case
from riskloom.plans.tables import Tables


def joined(df, key):
    return df.select(key, F.array_join("errors", "; ").alias("errors"))


def errors_sql(rules: list[tuple[str, str]]) -> str:
    """`rules`: (failed condition, message)."""
    parts = ", ".join(f"case when {c} then '{m}' end" for c, m in rules)
    return f"array_to_string(list_filter([{parts}], lambda m: m is not null), '; ') as errors"


@case(
    "v1_validate",
    f"""select loan_id, {errors_sql([("credit_score >= 800", "score too high"), ("debt_to_income is null or debt_to_income > 9e-1", "dti too high")])} from loans""",
)
def _(t: Tables):
    rules = [V.Rule("score too high", F.col("credit_score") < 800), V.Rule("dti too high", F.col("debt_to_income") <= 0.9)]
    return joined(V.validate(t.loans, rules), "loan_id")


@case("v1_quarantine", "select 'valid' as part, count(*) as n from loans where credit_score < 800 union all select 'invalid', count(*) from loans where credit_score >= 800")
def _(t: Tables):
    good, bad = V.quarantine(t.loans, [V.Rule("score too high", F.col("credit_score") < 800)])
    n = lambda df, p: df.agg(F.lit(p).alias("part"), F.count(F.lit(1)).alias("n"))
    return n(good, "valid").unionByName(n(bad, "invalid"))


DIRTY = """select transaction_key, case when transaction_key % 101 = 0 then null else account_id end as account_id, transaction_date, transaction_type,
  case when transaction_key % 97 = 0 then -amount else amount end as amount, case when transaction_key % 89 = 0 then 'usd' else 'inr' end as currency,
  case when transaction_key % 83 = 0 then 'gift' else category end as category, case when transaction_key % 79 = 0 then 'WIRE' else channel end as channel, verification_status from transactions"""


@case(
    "v2_transaction_rules",
    f"""select errors, count(*) as n from (select {errors_sql([
        ("account_id is null", "Missing required field: account_id"), ("transaction_date is null", "Missing required field: transaction_date"),
        ("amount < 0", "amount must be at least 0"), ("upper(currency) <> 'INR'", "only INR is supported"),
        ("transaction_type not in ('credit', 'debit', 'emi_payment', 'interest', 'fee')", "unknown transaction_type"),
        ("category = 'gift'", "unknown category"), ("channel = 'WIRE'", "unknown channel")])} from ({DIRTY}) d) e group by errors""",
)
def _(t: Tables):
    checked = V.validate(t.sql(DIRTY), V.transaction_rules())
    return checked.groupBy(F.array_join("errors", "; ").alias("errors")).agg(F.count(F.lit(1)).alias("n"))


APPLY = """select loan_id, case when loan_id % 10 = 0 then null else customer_id end as customer_id, case when loan_id % 11 = 0 then 0e0 else loan_amount end as loan_amount,
  case when loan_id % 13 = 0 then 55e0 else interest_rate end as interest_rate, case when loan_id % 17 = 0 then 'payday' else loan_type end as loan_type,
  tenure_months, case when loan_id % 19 = 0 then null else 'employed' end as employment_status, annual_income from loans"""


@case(
    "v3_application_rules",
    f"""select loan_id, {errors_sql([("customer_id is null", "Missing required field: customer_id"), ("employment_status is null", "Missing required field: employment_status"),
      ("loan_amount <= 0", "Loan amount must be positive"), ("interest_rate <= 0 or interest_rate > 50", "Interest rate must be between 0 and 50 percent"),
      ("loan_type = 'payday'", "Invalid loan_type")])} from ({APPLY}) a""",
)
def _(t: Tables):
    return joined(V.validate(t.sql(APPLY), V.application_rules()), "loan_id")


SCORING = """select loan_id, loan_amount, interest_rate, case when loan_id % 9 = 0 then null else annual_income end as annual_income,
  case when loan_id % 8 = 0 then 12e-1 else debt_to_income end as debt_to_income, case when loan_id % 7 = 0 then 900 when loan_id % 12 = 0 then null else credit_score end as credit_score, employment_length from loans"""


@case(
    "v4_scoring_rules",
    f"""select loan_id, {errors_sql([("annual_income is null", "Missing required field: annual_income"), ("credit_score is null", "Missing required field: credit_score"),
      ("credit_score < 300 or credit_score > 850", "Credit score out of range"), ("debt_to_income < 0 or debt_to_income > 1", "DTI out of range")])} from ({SCORING}) a""",
)
def _(t: Tables):
    return joined(V.validate(t.sql(SCORING), V.scoring_rules()), "loan_id")


REQUEST = """select loan_id, 10 + loan_id % 120 as age, annual_income - 4e4 as income, interest_rate * 4 as interest_rate, tenure_months - 8 as term_months,
  credit_score, total_credit_utilization * 3 as revolving_utilization from loans"""


@case(
    "v5_request_rules",
    f"""select loan_id, {errors_sql([("age < 18 or age > 120", "age out of range"), ("income < 0", "income out of range"), ("interest_rate < 0 or interest_rate > 100", "interest_rate out of range"),
      ("term_months < 1", "term_months out of range"), ("credit_score < 300 or credit_score > 850", "credit_score out of range"), ("revolving_utilization < 0 or revolving_utilization > 2", "revolving_utilization out of range")])} from ({REQUEST}) a""",
)
def _(t: Tables):
    df = t.sql(REQUEST)
    return joined(V.validate(df, V.request_rules(df.columns)), "loan_id")


@case(
    "v6_decision_rules",
    f"""select loan_id, {errors_sql([("lower(decision) not in ('approved', 'rejected', 'conditional', 'manual_review')", "Invalid decision"), ("rate < 0 or rate > 50", "Interest rate must be between 0 and 50 percent")])}
    from (select loan_id, case loan_id % 4 when 0 then 'Approved' when 1 then 'rejected' when 2 then 'maybe' else 'manual_review' end as decision, interest_rate * 2 as rate from loans) a""",
)
def _(t: Tables):
    df = t.sql(
        "select loan_id, case loan_id % 4 when 0 then 'Approved' when 1 then 'rejected' when 2 then 'maybe' else 'manual_review' end as decision, interest_rate * 2 as rate from loans"
    )
    return joined(V.validate(df, V.decision_rules()), "loan_id")


DISBURSE = """select loan_id, case when loan_id % 6 = 0 then 0e0 else loan_amount end as amount, case when loan_id % 5 = 0 then null else 'B1' end as bank_code,
  cast(customer_id as varchar(20)) as account_number, case when loan_id % 4 = 0 then null else 'IF1' end as ifsc_code from loans"""


@case(
    "v6_disbursement_rules",
    f"""select loan_id, {errors_sql([("amount <= 0", "Disbursement amount must be positive"), ("bank_code is null", "Missing account details: bank_code"), ("ifsc_code is null", "Missing account details: ifsc_code")])} from ({DISBURSE}) a""",
)
def _(t: Tables):
    return joined(V.validate(t.sql(DISBURSE), V.disbursement_rules()), "loan_id")


REPAY = "select loan_id, loan_amount - 1e5 as principal, interest_rate * 2 as rate, tenure_months * 4 as tenure from loans"


@case(
    "v6_repayment_rules",
    f"""select loan_id, {errors_sql([("principal <= 0", "Principal must be positive"), ("rate <= 0 or rate > 50", "Interest rate must be between 0 and 50 percent"), ("tenure < 1 or tenure > 360", "Tenure must be between 1 and 360 months")])} from ({REPAY}) a""",
)
def _(t: Tables):
    return joined(V.validate(t.sql(REPAY), V.repayment_rules()), "loan_id")


@case(
    "v6_consent_rules",
    f"""select loan_id, {errors_sql([("loan_id % 3 = 0", "Invalid data_types"), ("length(purpose) < 3", "Purpose must have at least 3 characters")])}
    from (select loan_id, case when loan_id % 7 = 0 then 'x' else loan_type end as purpose from loans) a""",
)
def _(t: Tables):
    k = F.col("loan_id")
    df = t.loans.select(
        "loan_id",
        F.when(k % 7 == 0, "x").otherwise(F.col("loan_type")).alias("purpose"),
        F.array(F.lit("deposit"), F.when(k % 3 == 0, "crypto").otherwise("equity")).alias("data_types"),
    )
    return joined(V.validate(df, V.consent_rules()), "loan_id")


HOLEY = """select l_orderkey, case when l_orderkey % 4 = 0 then null else l_quantity end as l_quantity, case when l_linenumber = 2 then null else l_returnflag end as l_returnflag, l_tax from lineitem"""


@case(
    "v7_null_profile",
    f"""with h as ({HOLEY}), s as (select avg(case when l_orderkey is null then 1e0 else 0e0 end) as a, avg(case when l_quantity is null then 1e0 else 0e0 end) as b,
      avg(case when l_returnflag is null then 1e0 else 0e0 end) as c, avg(case when l_tax is null then 1e0 else 0e0 end) as d from h)
    select unnest(['l_orderkey', 'l_quantity', 'l_returnflag', 'l_tax']) as "column", unnest([a, b, c, d]) as null_share, (a + b + c + d) / 4 as mean_null_share, (a + b + c + d) / 4 < 5e-1 as passed from s""",
    r6="null_share mean_null_share",
)
def _(t: Tables):
    return V.null_profile(t.sql(HOLEY))


@case(
    "v8_duplicate_share",
    """with g as (select l_orderkey, l_linenumber, l_returnflag, count(*) as n from lineitem group by all)
    select cast(sum(n) as bigint) as rows, count(*) as distinct_rows, 1 - count(*) / cast(sum(n) as double) as duplicate_share, 1 - count(*) / cast(sum(n) as double) < 3e-1 as passed from g""",
    r6="duplicate_share",
)
def _(t: Tables):
    return V.duplicate_share(t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag"))


@case(
    "v9_target_distribution",
    """with n as (select y, count(*) as n from scored group by y) select y, n, n / (select cast(sum(n) as double) from n) as share, (select max(n) / cast(min(n) as double) from n) as imbalance_ratio from n""",
    r6="share imbalance_ratio",
)
def _(t: Tables):
    return V.target_distribution(t.scored, "y")


def _outliers(cols) -> str:
    parts = [
        f"""select '{c}' as "column", q[1] as p1, q[2] as p99, avg(case when {c} < q[1] or {c} > q[2] then 1e0 else 0e0 end) as outlier_share
        from lineitem cross join (select [quantile_cont({c}, 0.01), quantile_cont({c}, 0.99)] as q from lineitem) z{i} group by q"""
        for i, c in enumerate(cols)
    ]
    return " union all ".join(parts)


OUT_COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@case(
    "v10_outlier_share",
    f"select *, outlier_share <= 5e-2 as passed from ({_outliers(OUT_COLS)}) o",
    r6="outlier_share",
    r4="p1 p99",
)
def _(t: Tables):
    return V.outlier_share(t.lineitem, OUT_COLS)


@case(
    "v11_dataset_stats",
    """select count(*) as n_samples, 4 as n_features, (avg(abs(l_quantity)) + avg(abs(l_extendedprice)) + avg(abs(l_discount)) + avg(abs(l_tax))) / 4 as mean_abs,
      (stddev_samp(l_quantity) + stddev_samp(l_extendedprice) + stddev_samp(l_discount) + stddev_samp(l_tax)) / 4 as std, 0e0 as null_pct from lineitem""",
    r4="mean_abs std null_pct",
)
def _(t: Tables):
    return V.dataset_stats(t.lineitem, OUT_COLS)


@case(
    "v12_validation_report",
    f"""with l as (select loan_id, loan_amount, credit_score, loan_type, case when months_since_issue <= 12 and loan_status in ('Charged Off', 'Default', 'Late (16-30 days)', 'Late (31-120 days)', 'In Grace Period') then 1 else 0 end as y from loans),
    n as (select y, count(*) as n from l group by y),
    r as (select 'null_percentage' as "check", true as passed, 0e0 as value union all select 'duplicate_check', true, 0e0
      union all select 'target_distribution', true, round(max(n) / cast(min(n) as double), 2) from n)
    select * from r union all select 'overall', true, 3e0""",
    r4="value",
)
def _(t: Tables):
    df = default_label(t.loans, out="y").select("loan_id", "loan_amount", "credit_score", "loan_type", "y")
    return V.validation_report(df, "y", numeric=["loan_amount", "credit_score"])


@case(
    "m28_runs_compare",
    """with l as (select * from runs order by start_time desc limit 10)
    select l.run_id, l.run_name, l.status, l.start_time, l.end_time - l.start_time as duration_ms,
      max(case when p.key = 'segment' then p.value end) as segment, max(case when p.key = 'nation' then p.value end) as nation,
      max(case when m.key = 'val_auc' then m.value end) as val_auc, max(case when m.key = 'f1' then m.value end) as f1
    from l join run_params p on p.run_id = l.run_id join run_metrics m on m.run_id = l.run_id group by 1, 2, 3, 4, 5""",
    r6="val_auc f1",
)
def _(t: Tables):
    return M.runs_compare(t.runs, t.run_params, t.run_metrics, {"params": ["segment", "nation"], "metrics": ["val_auc", "f1"]})


@case("m29_best_run", "select run_id, value from run_metrics where key = 'val_auc' order by value desc, run_id limit 1", r6="value")
def _(t: Tables):
    return M.best_run(t.run_metrics, "val_auc")


@case(
    "m29_promote",
    "select (select run_id from run_metrics where key = 'val_auc' order by value desc, run_id limit 1) = 5 as promote",
)
def _(t: Tables):
    return M.promote(t.run_metrics, "val_auc", 5)


@case("m30_latest_version", "select name, max(cast(version as int)) as version, 'production' as stage from model_versions group by name")
def _(t: Tables):
    return M.latest_version(t.model_versions)


@case(
    "m31_log_run",
    "select run_id, key, value from run_metrics where run_id % 7 <> 0",
    r6="value",
)
def _(t: Tables):
    import tempfile

    from riskloom.session import scratch_dir

    # Write with some non-finite values, as a run would log them, and read the table back.
    k = F.col("run_id") % 14
    odd = F.when(k == 0, F.lit(float("nan"))).when(k == 7, F.lit(float("inf"))).otherwise(F.col("value"))
    folder = f"{scratch_dir(t.spark)}/runs-{next(tempfile._get_candidate_names())}"
    M.append_metrics(t.run_metrics.withColumn("value", odd), folder)
    return t.spark.read.parquet(f"{folder}/run_metrics")
