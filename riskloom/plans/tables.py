"""The test tables and the lending-shaped views on them.

`VIEWS` holds SQL that Spark and DuckDB both read. In Spark the table names are bound to
DataFrames; for DuckDB they become common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.scan import row_ranks
from riskloom.session import cut_lineage

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    "loans": """
select o.o_orderkey as loan_id, o.o_custkey as customer_id,
  o.o_totalprice as loan_amount,
  2e4 + (c.c_acctbal + 1e3) * 12e0 as annual_income,
  o.o_totalprice / 4e1 as installment_amount,
  cast((o.o_orderkey * 37) % 101 as double) / 1e2 as debt_to_income,
  cast((o.o_orderkey * 53) % 101 as double) / 1e2 as total_credit_utilization,
  cast(350 + (o.o_orderkey * 13) % 2451 as double) / 1e2 as interest_rate,
  cast(300 + (o.o_orderkey * 7919 + o.o_custkey * 31) % 551 as int) as credit_score,
  cast((o.o_orderkey * 29) % 21 as int) as employment_length,
  cast((o.o_orderkey * 41) % 121 as int) as months_since_last_delinquency,
  cast((o.o_orderkey * 19) % 31 as int) as open_credit_lines,
  cast((o.o_orderkey * 23) % 61 as int) as total_acc,
  cast((o.o_orderkey * 43) % 4 as int) as num_derogatory_records,
  cast((o.o_orderkey * 47) % 3 as int) as num_collections_12m,
  cast((o.o_orderkey * 59) % 6 as int) as delinquency_2yrs,
  cast((o.o_orderkey * 61) % 50000 as double) as total_revolving_bal,
  cast((o.o_orderkey * 67) % 60000 as double) as total_revolving_credit_limit,
  cast((o.o_orderkey * 71) % 90000 as double) as total_current_balance,
  cast((o.o_orderkey * 73) % 375 as int) as months_since_first_credit_line,
  cast(1 + (o.o_orderkey * 11) % 60 as int) as months_since_issue,
  cast(6 + (o.o_orderkey * 7) % 115 as int) as tenure_months,
  case o.o_orderkey % 6 when 0 then 'personal' when 1 then 'mortgage' when 2 then 'auto'
    when 3 then 'business' when 4 then 'student' else 'credit_card' end as loan_type,
  case c.c_mktsegment when 'AUTOMOBILE' then 'prime' when 'BUILDING' then 'near_prime'
    when 'FURNITURE' then 'subprime' when 'MACHINERY' then 'deep_subprime' else 'prime' end as borrower_segment,
  case o.o_orderpriority when '1-URGENT' then 'A' when '2-HIGH' then 'B' when '3-MEDIUM' then 'C'
    when '4-NOT SPECIFIED' then 'D' else 'E' end as risk_grade,
  case (o.o_orderkey * 17) % 7 when 0 then 'Fully Paid' when 1 then 'Current'
    when 2 then 'Late (16-30 days)' when 3 then 'Late (31-120 days)' when 4 then 'Charged Off'
    when 5 then 'Default' else 'In Grace Period' end as loan_status,
  o.o_orderdate as issue_date
from orders o join customer c on o.o_custkey = c.c_custkey""",
    "transactions": """
select l.l_orderkey * 8 + l.l_linenumber as transaction_key,
  o.o_custkey as account_id,
  case when l.l_linenumber = 2 then l.l_partkey % 3 else null end as loan_id,
  l.l_shipdate as transaction_date,
  case l.l_linenumber when 1 then 'credit' when 2 then 'emi_payment' when 3 then 'fee'
    when 4 then 'credit' else 'debit' end as transaction_type,
  l.l_extendedprice as amount,
  case (l.l_partkey + l.l_linenumber) % 11 when 0 then 'salary' when 1 then 'groceries' when 2 then 'rent'
    when 3 then 'entertainment' when 4 then 'business' when 5 then 'utilities'
    when 6 then 'medical' when 7 then 'education' when 8 then 'transfer'
    when 9 then 'investment' else 'other' end as category,
  case l.l_suppkey % 8 when 0 then 'NEFT' when 1 then 'RTGS' when 2 then 'UPI'
    when 3 then 'IMPS' when 4 then 'CHEQUE' when 5 then 'CASH' when 6 then 'ATM'
    else 'CARD' end as channel,
  case when l.l_tax > 65e-3 then 'failed' when l.l_tax > 55e-3 then 'pending'
    else 'verified' end as verification_status,
  p.p_brand as merchant_name,
  l.l_quantity * 1e3 - 5e3 as balance_after
from lineitem l join orders o on l.l_orderkey = o.o_orderkey join part p on l.l_partkey = p.p_partkey""",
    "scored": """
select o_orderkey as loan_id,
  cast((o_orderkey * 2654435 + 12345) % 10007 as double) / 10007e0 as p,
  case when (o_orderkey * 2654435 + 12345) % 10007 + (o_orderkey * 97) % 5000 > 9000
    then 1 else 0 end as y,
  o_orderpriority as segment
from orders""",
    "events_txn": """
select event_id as transaction_key, user_id as account_id, ts as transaction_date,
  case event_type when 'purchase' then 'debit' when 'signup' then 'credit'
    when 'view' then 'emi_payment' when 'error' then 'fee' else 'debit' end as transaction_type,
  value as amount,
  'other' as category,
  case event_id % 8 when 0 then 'NEFT' when 1 then 'RTGS' when 2 then 'UPI'
    when 3 then 'IMPS' when 4 then 'CHEQUE' when 5 then 'CASH' when 6 then 'ATM'
    else 'CARD' end as channel,
  event_type as merchant_name
from events""",
    "errors": """
select row_number() over (order by ts, event_id) - 1 as seq,
  case when ts < timestamp '2024-01-16 00:00:00' then 'ref' else 'cur' end as side,
  case when event_id % 5 = 0 then 1 else 0 end as label,
  case when ts < timestamp '2024-01-16 00:00:00' then cast(event_id % 5 as double) / 2e1
    else cast((event_id * 7) % 11 as double) / 11e0 end as pred
from events""",
    "statements": """
select o_orderkey as row_id,
  case o_orderkey % 4 when 0 then null else concat(lpad(cast(extract(day from o_orderdate) as varchar(2)), 2, '0'),
    '-', lpad(cast(extract(month from o_orderdate) as varchar(2)), 2, '0'), '-',
    cast(extract(year from o_orderdate) as varchar(4))) end as "Date",
  case o_orderkey % 4 when 0 then concat(cast(extract(year from o_orderdate) as varchar(4)), '/',
    cast(extract(month from o_orderdate) as varchar(2)), '/',
    cast(extract(day from o_orderdate) as varchar(2))) else null end as "Txn Date",
  case o_orderkey % 13 when 0 then 'NEFT SALARY CREDIT' when 1 then 'UPI/bigbasket grocery order'
    when 2 then 'House RENT by cheque' when 3 then 'Netflix monthly subscription card'
    when 4 then 'IMPS payment to vendor 77' when 5 then 'Airtel broadband auto-debit'
    when 6 then 'City hospital POS swipe' when 7 then 'College tuition fee RTGS'
    when 8 then 'sent to friend GPAY' when 9 then 'SIP mutual fund' when 10 then 'ATM withdrawal'
    when 11 then 'misc' else '' end as "Narration",
  case when o_orderkey % 3 = 0 then concat('Rs ', cast(o_custkey * 7 as varchar(20)), '.50') else '0' end as "Debit",
  case when o_orderkey % 5 = 0 then concat(cast(o_custkey * 11 as varchar(20)), '.25') else '' end as "Credit",
  concat(cast(o_custkey as varchar(20)), ',000.75') as "Balance",
  concat('AC', cast(o_custkey as varchar(20))) as "Account No"
from orders""",
    "upi": """
select o_orderkey as row_id,
  concat(cast(extract(day from o_orderdate) as varchar(2)), '/',
    cast(extract(month from o_orderdate) as varchar(2)), '/',
    cast(extract(year from o_orderdate) as varchar(4))) as "Date",
  concat('user', cast(o_custkey as varchar(20)), '@bank') as "VPA",
  case when o_orderkey % 11 = 0 then '0' else cast(o_custkey * 3 as varchar(20)) end as "Amount",
  case o_orderkey % 4 when 0 then 'success' when 1 then 'COMPLETED' when 2 then 'failed' else null end as "Status",
  case o_orderkey % 3 when 0 then 'Received from shop' when 1 then 'movie night' else 'doctor visit' end as "Note",
  concat('AC', cast(o_custkey as varchar(20))) as "From Account"
from orders""",
    "importances": """
select event_type as feature, sum(case when side = 'a' then w else 0e0 end) as reference_importance,
  sum(case when side = 'b' then w else 0e0 end) as current_importance
from (select concat(event_type, '_', cast(user_id % 5 as varchar(2))) as event_type,
        case when event_id % 3 = 0 then 'a' else 'b' end as side, value as w from events) e
group by event_type""",
    "runs": """
select c_custkey as run_id, concat('run_', cast(c_nationkey as varchar(3))) as run_name,
  case when c_custkey % 9 = 0 then 'FAILED' else 'FINISHED' end as status,
  c_custkey * 60000 as start_time,
  case when c_custkey % 10 = 3 then null else c_custkey * 60000 + 1000 + c_nationkey * 17 end as end_time
from customer""",
    "run_params": """
select c_custkey as run_id, 'segment' as key, c_mktsegment as value from customer
union all select c_custkey, 'nation', cast(c_nationkey as varchar(3)) from customer""",
    "run_metrics": """
select c_custkey as run_id, 'val_auc' as key, (c_acctbal + 1e3) / 12e3 as value from customer
union all select c_custkey, 'f1', c_acctbal / 1e4 from customer""",
    "model_versions": """
select concat('model_', cast(c_nationkey as varchar(3))) as name, cast(c_custkey as varchar(20)) as version
from customer""",
}

# Views a view is built on.
_NEEDS = {name: set(re.findall(r"\w+", sql)) & set(VIEWS) - {name} for name, sql in VIEWS.items()}


class Tables:
    """Base tables and views of one data folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name == "errors":
            return self._errors()
        if name in VIEWS:
            return self.sql(VIEWS[name])
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        """Run SQL over base tables and views, without registering global views."""
        used = [n for n in [*BASE, *VIEWS] if re.search(rf"\b{n}\b", text)]
        body = text.replace('"', "`")
        for n in used:
            body = re.sub(rf"(?<=from )\b{n}\b|(?<=join )\b{n}\b", f"{{{n}}}", body)
        bound = [n for n in used if f"{{{n}}}" in body]
        return self.spark.sql(body, **{n: getattr(self, n) for n in bound})

    def _errors(self) -> DataFrame:
        """The ordered error sequence; numbering by slices instead of one global window."""
        late = F.col("ts") >= F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
        e = self.events.select(
            F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
            "event_id",
            F.when(late, "cur").otherwise("ref").alias("side"),
            F.when(F.col("event_id") % 5 == 0, 1).otherwise(0).alias("label"),
            F.when(late, ((F.col("event_id") * 7) % 11).cast("double") / F.lit(11.0))
            .otherwise((F.col("event_id") % 5).cast("double") / F.lit(20.0))
            .alias("pred"),
        )
        ranked = cut_lineage(row_ranks(e, "at", "event_id", "seq"))
        return ranked.select((F.col("seq") - 1).alias("seq"), "side", "label", "pred")


def duck_sql(text: str) -> str:
    """The same SQL for DuckDB: views it uses become common table expressions."""
    wanted: list[str] = []

    def visit(name: str) -> None:
        for need in sorted(_NEEDS[name]):
            visit(need)
        if name not in wanted:
            wanted.append(name)

    for name in VIEWS:
        if re.search(rf"(from|join) {name}\b", text):
            visit(name)
    if not wanted:
        return text
    ctes = ",\n".join(f"{n} as ({VIEWS[n]})" for n in wanted)
    stripped = text.strip()
    if stripped.lower().startswith("with "):
        return f"with {ctes},\n{stripped[5:]}"
    return f"with {ctes}\n{stripped}"
