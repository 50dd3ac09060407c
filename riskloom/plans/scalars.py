"""Scalar and text expressions on the test tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions import scalars as X
from riskloom.functions import text as tx
from riskloom.plans.registry import case
from riskloom.plans.tables import Tables


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w + "'" for w in words) + "]"


def sql_any(expr: str, words) -> str:
    return "(" + " or ".join(f"contains({expr}, '{w}')" for w in words) + ")"


def sql_first(expr: str, groups, default: str) -> str:
    whens = " ".join(f"when {sql_any(expr, ws)} then '{n}'" for n, ws in groups.items())
    return f"case {whens} else '{default}' end"


def sql_band(p: str, edges, names) -> str:
    whens = " ".join(f"when {p} < {e!r} then '{n}'" for e, n in zip(edges, names))
    return f"case {whens} else '{names[-1]}' end"


MONTHS = "substr('JanFebMarAprMayJunJulAugSepOctNovDec', cast(extract(month from o_orderdate) * 3 - 2 as int), 3)"
DATE_TEXT = f"""select o_orderkey as row_id, concat(case o_orderkey % 7
  when 0 then concat(cast(extract(day from o_orderdate) as varchar(2)), '-', cast(extract(month from o_orderdate) as varchar(2)), '-', cast(extract(year from o_orderdate) as varchar(4)))
  when 1 then concat(cast(extract(day from o_orderdate) as varchar(2)), '/', cast(extract(month from o_orderdate) as varchar(2)), '/', cast(extract(year from o_orderdate) as varchar(4)))
  when 2 then concat(cast(extract(year from o_orderdate) as varchar(4)), '-', cast(extract(month from o_orderdate) as varchar(2)), '-', cast(extract(day from o_orderdate) as varchar(2)))
  when 3 then concat(cast(extract(month from o_orderdate) as varchar(2)), '/', cast(extract(day from o_orderdate) as varchar(2)), '/', cast(extract(year from o_orderdate) as varchar(4)))
  when 4 then concat(cast(extract(day from o_orderdate) as varchar(2)), ' ', {MONTHS}, ' ', cast(extract(year from o_orderdate) as varchar(4)))
  when 5 then concat(cast(extract(day from o_orderdate) as varchar(2)), '-', {MONTHS}, '-', cast(extract(year from o_orderdate) as varchar(4)))
  else concat('on ', o_orderpriority) end, ' ') as s
from orders"""


@case(
    "x1_parse_date",
    f"select row_id, try_strptime(trim(s), {sql_list(X.STRPTIME_PATTERNS)}) as parsed from ({DATE_TEXT}) t",
)
def _(t: Tables):
    return t.sql(DATE_TEXT).select("row_id", X.parse_date(F.col("s")).alias("parsed"))


NUMBER_TEXT = """select o_orderkey as row_id, case o_orderkey % 5 when 0 then concat('Rs. ', cast(o_custkey as varchar(20)))
  when 1 then concat('(', cast(o_custkey as varchar(20)), ',250.75)') when 2 then 'n/a' when 3 then concat('-', cast(o_custkey as varchar(20)), '.5 INR')
  else cast(o_custkey as varchar(20)) end as s from orders"""


@case(
    "x2_safe_number",
    f"""select row_id, coalesce(try_cast(regexp_replace(s, '[^0-9.\\-]', '', 'g') as double), 0e0) as number
    from ({NUMBER_TEXT}) t""",
)
def _(t: Tables):
    return t.sql(NUMBER_TEXT).select("row_id", X.safe_number(F.col("s")).alias("number"))


STATEMENT_TEXT = 'select row_id, "Narration" as s from statements'


@case(
    "x3_infer_category",
    f"select row_id, {sql_first('lower(s)', X.CATEGORY_KEYWORDS, 'other')} as category from ({STATEMENT_TEXT}) t",
)
def _(t: Tables):
    return t.sql(STATEMENT_TEXT).select("row_id", X.infer_category(F.col("s")).alias("category"))


@case(
    "x4_infer_channel",
    f"select row_id, {sql_first('lower(s)', X.CHANNEL_KEYWORDS, 'NEFT')} as channel from ({STATEMENT_TEXT}) t",
)
def _(t: Tables):
    return t.sql(STATEMENT_TEXT).select("row_id", X.infer_channel(F.col("s")).alias("channel"))


@case(
    "x5_is_recurring",
    f"select row_id, {sql_any('lower(s)', X.RECURRING_KEYWORDS)} as recurring from ({STATEMENT_TEXT}) t",
)
def _(t: Tables):
    return t.sql(STATEMENT_TEXT).select("row_id", X.is_recurring(F.col("s")).alias("recurring"))


@case(
    "x6_festival_multiplier",
    """select o_orderkey, case when m in (10, 11) then 14e-1 when m in (11, 12, 1, 2, 3) then 12e-1
      when m in (4, 5, 6) then 115e-2 when m = 12 then 11e-1 else 1e0 end as multiplier
    from (select o_orderkey, extract(month from o_orderdate) as m from orders) t""",
)
def _(t: Tables):
    return t.orders.select("o_orderkey", X.festival_multiplier(F.month("o_orderdate")).alias("multiplier"))


@case(
    "x7_clean_text",
    """select doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z\\s]', ' ', 'g'), '\\s+', ' ', 'g')) as cleaned
    from documents""",
)
def _(t: Tables):
    return t.documents.select("doc_id", tx.clean_text(F.col("text")).alias("cleaned"))


_LOW = "lower(text)"
TEXT_STATS_SQL = f"""length(text) as text_length,
  cast(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) as int) as word_count,
  case when len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) > 0
    then length(regexp_replace(text, '\\s+', '', 'g')) / cast(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) as double)
    else 0e0 end as avg_word_length,
  cast(len(regexp_extract_all(text, '\\p{{Lu}}')) as int) as num_uppercase,
  cast(len(regexp_extract_all(text, '[^\\p{{L}}\\p{{N}}\\s]')) as int) as num_special_chars,
  case when {sql_any(_LOW, tx.FINANCIAL_TERMS)} then 1 else 0 end as has_financial_terms,
  {" + ".join(f"(case when contains({_LOW}, '{k}') then 1 else 0 end)" for k in tx.RISK_KEYWORDS)} as risk_keywords_count"""


@case(
    "x8_text_stats",
    f"select doc_id, cast(text_length as int) as text_length, * exclude (doc_id, text_length) from (select doc_id, {TEXT_STATS_SQL} from documents) s",
    r6="avg_word_length",
)
def _(t: Tables):
    return t.documents.select("doc_id", *[c.alias(n) for n, c in tx.text_stats(F.col("text")).items()])


@case(
    "x9_combine_text",
    "select doc_id, concat_ws(' ', source, lang, text) as combined from documents",
)
def _(t: Tables):
    return t.documents.select("doc_id", tx.combine_text(["source", "lang", "text"]).alias("combined"))


def _lexicon_values() -> str:
    return ", ".join(f"('{w}', {p!r}::double, {s!r}::double)" for w, (p, s) in tx.LEXICON.items())


# The texts hold few of the words that are scored, so most get two of them and some get none.
_SCORED = list(tx.LEXICON)
_SPAN = len(_SCORED) + 5


def _scored_text_sql() -> str:
    words = ", ".join(f"'{w}'" for w in _SCORED)
    return f"concat_ws(' ', text, [{words}][doc_id % {_SPAN} + 1], [{words}][doc_id // 3 % {_SPAN} + 1])"


def _scored_text() -> Column:
    words = F.array(*[F.lit(w) for w in _SCORED])
    return F.concat_ws(" ", "text", F.get(words, F.col("doc_id") % _SPAN), F.get(words, F.floor(F.col("doc_id") / 3) % _SPAN))


@case(
    "x10_sentiment",
    f"""with lex(word, pol, sub) as (values {_lexicon_values()}),
    words as (select doc_id, unnest(string_split(trim(regexp_replace(regexp_replace(lower({_scored_text_sql()}), '[^a-z\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' ')) as word from documents),
    s as (select doc_id, avg(pol) as polarity, avg(sub) as subjectivity from words join lex using (word) group by doc_id)
    select d.doc_id, coalesce(s.polarity, 0e0) as polarity, coalesce(s.subjectivity, 0e0) as subjectivity
    from documents d left join s on d.doc_id = s.doc_id""",
    r6="polarity subjectivity",
)
def _(t: Tables):
    return t.documents.select("doc_id", tx.sentiment(_scored_text()).alias("s")).select(
        "doc_id", "s.polarity", "s.subjectivity"
    )


@case(
    "x11_risk_category",
    f"select loan_id, {sql_band('p', X.RISK_EDGES, X.RISK_CLASSES)} as risk_category from scored",
)
def _(t: Tables):
    return t.scored.select("loan_id", X.risk_category(F.col("p")).alias("risk_category"))


@case(
    "x12_risk_category_cut",
    """select loan_id, case when p <= 0 or p > 1 then null when p <= 1e-1 then 'Very Low' when p <= 25e-2 then 'Low'
      when p <= 5e-1 then 'Medium' when p <= 75e-2 then 'High' else 'Very High' end as risk_category from scored""",
)
def _(t: Tables):
    return t.scored.select("loan_id", X.risk_category_cut(F.col("p")).alias("risk_category"))


@case(
    "x13_risk_band3",
    "select loan_id, case when p < 3e-1 then 'low_risk' when p < 6e-1 then 'medium_risk' else 'high_risk' end as band from scored",
)
def _(t: Tables):
    return t.scored.select("loan_id", X.risk_band3(F.col("p")).alias("band"))


@case(
    "x14_recommended_action",
    f"""select loan_id, {sql_band('p', X.RISK_EDGES, X.ACTIONS)} as action,
      case when p < 3e-1 then 'APPROVE – Low risk applicant' when p < 6e-1
        then 'REVIEW – Moderate risk, consider additional documentation' else 'DECLINE – High risk applicant' end as officer,
      case when p < 3e-1 then 'Approve' when p < 6e-1 then 'Review further' else 'Decline' end as executive
    from scored""",
)
def _(t: Tables):
    p = F.col("p")
    return t.scored.select(
        "loan_id",
        X.recommended_action(p).alias("action"),
        X.officer_action(p).alias("officer"),
        X.executive_action(p).alias("executive"),
    )


@case("x15_sigmoid", "select loan_id, 1 / (1 + exp(-(p * 8 - 4))) as s from scored", r6="s")
def _(t: Tables):
    return t.scored.select("loan_id", X.sigmoid(F.col("p") * 8 - 4).alias("s"))


@case(
    "x16_row_hash",
    """select o_orderkey, substr(sha256(concat('{"custkey":', cast(o_custkey as varchar), ',"priority":"', o_orderpriority,
      '","status":"', o_orderstatus, '"}')), 1, 16) as row_hash from orders""",
)
def _(t: Tables):
    return t.orders.select(
        "o_orderkey",
        X.row_hash(
            status=F.col("o_orderstatus"), custkey=F.col("o_custkey"), priority=F.col("o_orderpriority")
        ).alias("row_hash"),
    )


@case(
    "x17_flatten",
    """select c_custkey, unnest(['who/name', 'who/place/nation', 'who/place/segment', 'id']) as key,
      unnest([c_name, cast(c_nationkey as varchar), c_mktsegment, cast(c_custkey as varchar)]) as value from customer""",
)
def _(t: Tables):
    nested = t.customer.select(
        "c_custkey",
        F.struct(
            F.struct(
                F.col("c_name").alias("name"),
                F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).alias("place"),
            ).alias("who"),
            F.col("c_custkey").alias("id"),
        ).alias("doc"),
    )
    flat = nested.select("c_custkey", X.flatten_struct("doc", nested.schema["doc"].dataType).alias("m"))
    return flat.select("c_custkey", F.explode("m").alias("key", "value"))


@case(
    "x18_psi_class",
    "select loan_id, case when p >= 2e-1 then 'significant' when p >= 1e-1 then 'moderate' else 'stable' end as psi_class from scored",
)
def _(t: Tables):
    return t.scored.select("loan_id", X.psi_class(F.col("p")).alias("psi_class"))


FEATURE_NAMES = """select concat(p_name, case p_partkey % 9 when 0 then '_Credit_limit' when 1 then ' dti' when 2 then '_loan' when 3 then ' home'
  when 4 then '_delinquency' when 5 then '_tfidf_3' when 6 then '_month' when 7 then '_income' else '_x' end) as feature, p_partkey from part"""


@case(
    "x19_feature_category",
    f"select p_partkey, {sql_first('lower(feature)', X.FEATURE_GROUPS, 'other')} as category from ({FEATURE_NAMES}) t",
)
def _(t: Tables):
    return t.sql(FEATURE_NAMES).select("p_partkey", X.feature_category(F.col("feature")).alias("category"))


HUMAN = "select p_partkey, concat(replace(p_name, ' ', '_'), '_', lower(p_type)) as feature from part"


@case(
    "x20_humanize",
    f"""select p_partkey, array_to_string(list_transform(string_split(replace(feature, '_', ' '), ' '),
      lambda w: concat(upper(substr(w, 1, 1)), lower(substr(w, 2)))), ' ') as title from ({HUMAN}) t""",
)
def _(t: Tables):
    return t.sql(HUMAN).select("p_partkey", X.humanize(F.col("feature")).alias("title"))
