"""Sources, sinks and streams on the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import scalars as X
from riskloom.plans.registry import case, money
from riskloom.plans.scalars import sql_any, sql_first, sql_list
from riskloom.plans.tables import VIEWS, Tables
from riskloom.session import scratch_dir
from riskloom.sources import tables as S
from riskloom.streaming import drift_state as D
from riskloom.streaming import jobs as J


def fresh(t: Tables, name: str) -> str:
    return f"{scratch_dir(t.spark)}/riskloom/{name}-{uuid.uuid4().hex}"


CUSTOMER = "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer"


@case("s1_read_table_parquet", CUSTOMER)
def _(t: Tables):
    return S.read_table(t.spark, f"{t.folder}/customer.parquet")


@case("s1_read_table_csv", CUSTOMER)
def _(t: Tables):
    path = fresh(t, "csv") + "/customer.csv"
    S.write_csv(t.customer, path)
    return S.read_table(t.spark, path, t.customer.schema)


@case("s2_text_columns", """select 'text' as "column", count(text) as n from documents""")
def _(t: Tables):
    found = S.text_columns(t.documents)
    row = t.documents.agg(*[F.count(c).alias(c) for c in found])
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in found]
    return row.select(F.explode(F.array(*pairs)).alias("r")).select("r.*")


@case("s3_read_external", "select n_nationkey, n_name, n_regionkey from nation")
def _(t: Tables):
    path = fresh(t, "external")
    S.write_csv(t.nation, path)
    return S.read_external(t.spark, path, t.nation.schema)


@case("s4_read_dir", "select c_nationkey, count(*) as n, sum(cast(c_acctbal as decimal(18, 2))) as balance from customer group by c_nationkey")
def _(t: Tables):
    # Half of the rows as Parquet, half as CSV, without one column.
    path = fresh(t, "dir")
    t.customer.where("c_custkey % 2 = 0").write.mode("append").parquet(path)
    t.customer.where("c_custkey % 2 = 1").drop("c_name").write.mode("append").option("header", True).csv(path)
    both = S.read_dir(t.spark, path)
    return both.groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("decimal(38,2)").alias("balance")
    )


@case("s5_file_inventory", "select 'lineitem.parquet' as file, count(*) as rows, 11 as columns from lineitem")
def _(t: Tables):
    return S.file_inventory(t.lineitem)


NUM = "coalesce(try_cast(regexp_replace({}, '[^0-9.\\-]', '', 'g') as double), 0e0)"


@case(
    "s6_normalize_statement",
    f"""with r as (select row_id, try_strptime(trim(coalesce(nullif("Date", ''), nullif("Txn Date", ''))), {sql_list(X.STRPTIME_PATTERNS)}) as transaction_date, "Narration" as description,
      {NUM.format("coalesce(nullif(\"Debit\", ''), '0')")} as debit, {NUM.format("coalesce(nullif(\"Credit\", ''), '0')")} as credit, {NUM.format('"Balance"')} as balance_after, "Account No" as account_id from statements)
    select row_id, account_id, transaction_date, case when credit > 0 then 'credit' else 'debit' end as transaction_type, case when credit > 0 then credit else debit end as amount, balance_after,
      {sql_first('lower(description)', X.CATEGORY_KEYWORDS, 'other')} as category, description, {sql_first('lower(description)', X.CHANNEL_KEYWORDS, 'NEFT')} as channel,
      {sql_any('lower(description)', X.RECURRING_KEYWORDS)} as is_recurring from r where transaction_date is not null and (credit > 0 or debit > 0)""",
)
def _(t: Tables):
    return S.normalize_statement(t.statements, keep=["row_id"])


@case(
    "s7_normalize_upi",
    f"""with r as (select row_id, try_strptime("Date", {sql_list(X.STRPTIME_PATTERNS)}) as transaction_date, "VPA" as merchant_name, {NUM.format('"Amount"')} as amount, upper(coalesce("Status", 'SUCCESS')) as st,
      "Note" as description, "From Account" as account_id from upi)
    select row_id, account_id, transaction_date, case when contains(lower(description), 'received') then 'credit' else 'debit' end as transaction_type, amount, 0e0 as balance_after,
      {sql_first("lower(description || ' ' || merchant_name)", X.CATEGORY_KEYWORDS, 'other')} as category, merchant_name, description, 'UPI' as channel from r
    where st in ('SUCCESS', 'COMPLETED') and transaction_date is not null and amount > 0""",
)
def _(t: Tables):
    return S.normalize_upi(t.upi, keep=["row_id"])


@case("s8_write_processed", "select count(*) as rows, 4 as columns from transactions")
def _(t: Tables):
    df = t.transactions.select("account_id", "amount", "category", F.date_trunc("month", "transaction_date").cast("date").alias("month"))
    manifest = S.write_processed(df.repartition("month"), fresh(t, "processed"), ["month"])
    return manifest.agg(F.sum("rows").alias("rows"), F.max("columns").alias("columns"))


@case("s9_write_report", "select segment, count(*) as n from scored group by segment")
def _(t: Tables):
    path = fresh(t, "report")
    S.write_report(t.scored.groupBy("segment").agg(F.count(F.lit(1)).alias("n")), path)
    return t.spark.read.schema("segment string, n bigint").json(path)


@case("s10_write_csv", "select feature, reference_importance from importances", r4="reference_importance")
def _(t: Tables):
    path = fresh(t, "importances")
    S.write_csv(t.importances.select("feature", "reference_importance"), path)
    return S.read_external(t.spark, path, "feature string, reference_importance double")


LOANS_STREAM = VIEWS["loans"].replace("from orders o join customer c", "from {orders} o join {customer} c")


def loan_stream(t: Tables):
    """Applications from a stream of orders, joined with the static customers."""
    orders = J.file_stream(t.spark, t.folder, "orders.parquet")
    df = t.spark.sql(LOANS_STREAM.replace('"', "`"), orders=orders, customer=t.customer)
    # Some rows break the rules and go to quarantine.
    return df.withColumn("credit_score", F.when(F.col("loan_id") % 40 == 0, 900).otherwise(F.col("credit_score")))


@case(
    "st1_stream_score",
    f"""with l as (select *, greatest(least(5e-1 - (credit_score - 650) / 1e3 + (case when debt_to_income = 0 then 3e-1 else debt_to_income end) * 2e-1 - least(annual_income / 5e5, 1e-1) + num_derogatory_records * 5e-2, 99e-2), 1e-2) as p from loans)
    select loan_id, case when loan_id % 40 = 0 then null else {money('p', 4)} end as probability, case when loan_id % 40 = 0 then 'Credit score out of range' else '' end as errors from l""",
    r4="probability",
)
def _(t: Tables):
    valid, bad = fresh(t, "valid"), fresh(t, "quarantine")
    scored = J.stream_score(loan_stream(t)).select("loan_id", "probability", "errors")
    J.write_split(scored, valid, bad, fresh(t, "checkpoint"))
    schema = "loan_id bigint, probability double, errors array<string>"
    both = t.spark.read.schema(schema).parquet(valid).unionByName(t.spark.read.schema(schema).parquet(bad))
    return both.select("loan_id", "probability", F.array_join("errors", "; ").alias("errors"))


@case(
    "st2_stream_velocity",
    """with w as (select date_trunc('day', ts) as window_start, date_trunc('day', ts) + interval 1 day as window_end, event_type, count(*) as n, sum(value) as total, count(case when value > 100 then 1 end) as large_n from events group by 1, 2, 3)
    select * from w where window_end <= (select max(ts) - interval 1 day from events)""",
    r4="total",
)
def _(t: Tables):
    return J.run_to_table(J.stream_velocity(J.file_stream(t.spark, t.folder, "events.parquet"), "ts", ["event_type"], "value"))


DRIFT_SQL = """with e0 as (
  select user_id::varchar as key, ts::timestamp as ts, (case when event_id % 5 = 0 then 1 else 0 end)::double as y, (event_id % 7) / 7e0 as p
  from events where user_id is not null and ts is not null
),
g0 as (select *, case when epoch_ms(ts) - epoch_ms(lag(ts) over (partition by key order by ts, p, y)) > 2592000000 then 1 else 0 end as gap from e0),
g as (select *, sum(gap) over (partition by key order by ts, p, y rows between unbounded preceding and current row) as run from g0),
e as (select * from g qualify run = max(run) over (partition by key)),
a as (
  select *, abs(y - p) as e, row_number() over w as n, sum(abs(y - p)) over w as total,
    sum(case when (p >= 0.5) <> (y = 1) then 1 else 0 end) over w as wrong
  from e window w as (partition by key order by ts, p, y rows between unbounded preceding and current row)
),
b as (select *, sum(e - total / n - 0.005) over w as ph, wrong / n as rate from a window w as (partition by key order by ts, p, y rows between unbounded preceding and current row)),
c as (
  select *, least(0, min(ph) over w) as low, sqrt(rate * (1 - rate) / n) as s, case when n > 30 then rate + sqrt(rate * (1 - rate) / n) end as rs
  from b window w as (partition by key order by ts, p, y rows between unbounded preceding and current row)
),
d as (select *, min(rs) over w as m, arg_min(s, case when rs is not null then (rs, n) end) over w as sm from c window w as (partition by key order by ts, p, y rows between unbounded preceding and current row))
select key, max(n) as n, arg_max(total, n) / max(n) as mean_error, arg_max(ph - low, n) as page_hinkley, bool_or(ph - low > 5.0) as ph_drift,
  case when bool_or(rs > m + 2 * sm) then 'drift' when bool_or(rs > m + sm) then 'warning' else 'stable' end as ddm_level
from d group by key"""


def _drift_input(df: DataFrame) -> DataFrame:
    return df.select(
        "user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 5 == 0).cast("int").alias("label"),
        (F.col("event_id") % 7 / 7.0).alias("pred"),
    )


@case("st3_stream_drift", DRIFT_SQL, r6="mean_error page_hinkley")
def _(t: Tables):
    source = _drift_input(J.file_stream(t.spark, t.folder, "events.parquet"))
    emitted = D.run_bounded(source, lambda s: D.drift_monitor(s, "user_id", "ts", "label", "pred", threshold=5.0), "ts")
    return D.last_rows(emitted)


@case("st3_drift_batch", DRIFT_SQL, r6="mean_error page_hinkley")
def _(t: Tables):
    return D.drift_batch(_drift_input(t.events), "user_id", "ts", "label", "pred", threshold=5.0)


@case(
    "st4_stream_dedupe",
    """with recursive e as (select user_id, event_type, {'t': ts, 'id': event_id} as r from events where epoch_ms(ts) < (select epoch_ms(max(ts)) - 1800000 from events)),
    kept as (select user_id, event_type, min(r) as r from e group by all
      union all select user_id, event_type, min(e.r) from kept k join e using (user_id, event_type) where e.r.t > k.r.t + interval 30 minute group by user_id, event_type)
    select user_id, event_type, r.t as ts, r.id as event_id from kept""",
)
def _(t: Tables):
    e = J.file_stream(t.spark, t.folder, "events.parquet")
    return J.run_to_table(J.stream_dedupe(e, "ts", ["user_id", "event_type"], "event_id"))


@case(
    "st5_stream_sessions",
    """with g as (select user_id, ts, value, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minute then 0 else 1 end as b from events),
    s as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) as k from g),
    r as (select user_id, min(ts) as session_start, max(ts) + interval 30 minute as session_end, count(*) as n, sum(value) as total from s group by user_id, k)
    select * from r where session_end <= (select max(ts) - interval 1 hour from events)""",
    r4="total",
)
def _(t: Tables):
    return J.run_to_table(J.stream_sessions(J.file_stream(t.spark, t.folder, "events.parquet"), "ts", "user_id", "value"))


@case(
    "st6_stream_enrich",
    "select event_id, user_id, value, c_mktsegment as segment, c_acctbal as balance from events left join customer on c_custkey = user_id",
)
def _(t: Tables):
    static = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    e = J.file_stream(t.spark, t.folder, "events.parquet").select("event_id", "user_id", "value")
    return J.run_to_table(J.stream_enrich(e, static, "user_id")).select("event_id", "user_id", "value", "segment", "balance")
