"""Per-row attributions and what is told about them.

A row's attributions are a bounded array (one struct per model feature), so ranking,
waterfalls and texts are array expressions inside the row: no shuffle per row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.scalars import (
    executive_action,
    feature_category,
    first_match,
    humanize,
    officer_action,
    recommended_action,
    sigmoid,
)
from riskloom.operators.model import score
from riskloom.operators.scan import column_quantiles

_c = F.col


def linear_attributions(df: DataFrame, coef: Mapping[str, float], means: Mapping[str, float], out: str = "attributions") -> DataFrame:
    """Exact contributions coef · (x - mean) of a linear score, as an array of structs."""
    items = [
        F.struct(
            F.lit(f).alias("feature"),
            _c(f).cast("double").alias("value"),
            ((_c(f).cast("double") - F.lit(float(means[f]))) * F.lit(float(w))).alias("contribution"),
        )
        for f, w in coef.items()
    ]
    return df.withColumn(out, F.array(*items))


def feature_means(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    row = df.agg(*[F.avg(_c(f).cast("double")).alias(f) for f in features]).first()
    return {f: row[f] or 0.0 for f in features}


def long_form(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, feature, value, contribution) rows."""
    return df.select(*keys, F.explode("attributions").alias("a")).select(*keys, "a.feature", "a.value", "a.contribution")


def sampled_attributions(
    model: Model, df: DataFrame, key: str, features: Sequence[str], permutations: Sequence[Sequence[str]]
) -> DataFrame:
    """Sampled Shapley values of any model: (key, feature, contribution).

    A permutation switches the features of a row one by one from the mean to their value.
    All rows, permutations and steps are scored in one job.
    """
    means = feature_means(df, features)
    mine = {f: _c(f).cast("double") for f in features}
    steps = []
    for number, order in enumerate(permutations):
        done: set[str] = set()
        for place in range(len(order) + 1):
            vec = array_to_vector(F.array(*[mine[f] if f in done else F.lit(float(means[f])) for f in features]))
            steps.append(
                F.struct(
                    F.lit(order[place - 1] if place else "").alias("enters"),
                    F.lit(order[place] if place < len(order) else "").alias("next"),
                    vec.alias("features"),
                )
            )
            if place < len(order):
                done.add(order[place])
        del number
    rows = df.select(key, F.explode(F.array(*steps)).alias("s")).select(key, "s.enters", "s.next", "s.features")
    scored = score(model, rows).select(key, "enters", "next", "p")
    # The score after a feature entered counts for it, the score before against it.
    moves = scored.select(
        key, F.explode(F.array(F.struct(_c("enters").alias("f"), _c("p").alias("d")), F.struct(_c("next").alias("f"), (-_c("p")).alias("d")))).alias("m")
    ).where(_c("m.f") != "")
    return moves.groupBy(key, _c("m.f").alias("feature")).agg((F.sum("m.d") / len(permutations)).alias("contribution"))


def ranked(attributions: Column) -> Column:
    """Attributions by falling absolute contribution; equal ones by feature name."""

    def order(a: Column, b: Column) -> Column:
        x, y = F.abs(a["contribution"]), F.abs(b["contribution"])
        return (
            F.when(x > y, -1).when(x < y, 1).when(a["feature"] < b["feature"], -1).when(a["feature"] > b["feature"], 1).otherwise(0)
        )

    return F.array_sort(attributions, order)


def rank_attributions(df: DataFrame, n: int = 10) -> DataFrame:
    """Add `ranking` (top n), `risk_factors` and `protective_factors`."""
    top = df.withColumn("ranking", F.slice(ranked(_c("attributions")), 1, n))
    return top.withColumns(
        {
            "risk_factors": F.filter("ranking", lambda a: a["contribution"] > 0),
            "protective_factors": F.filter("ranking", lambda a: a["contribution"] <= 0),
        }
    )


def explanation_text(df: DataFrame) -> DataFrame:
    line = lambda word: lambda a: F.format_string(f"  - %s = %.4f ({word} %.4f)", a["feature"], a["value"], F.abs(a["contribution"]))
    risk = F.transform(F.slice("risk_factors", 1, 5), line("adds"))
    safe = F.transform(F.slice("protective_factors", 1, 3), line("reduces risk by"))
    none = F.array().cast("array<string>")
    head = lambda t, xs: F.when(F.size(xs) > 0, F.concat(F.array(F.lit(t)), xs)).otherwise(none)
    return df.withColumn(
        "explanation_text",
        F.array_join(F.concat(head("Key risk factors:", risk), head("Protective factors:", safe)), "\n"),
    )


def global_attributions(df: DataFrame) -> DataFrame:
    return long_form(df, []).groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"))


def _value(f: str) -> Column:
    return F.filter("attributions", lambda a: a["feature"] == f)[0]["contribution"]


def pair_strength(df: DataFrame, top: int = 5) -> DataFrame:
    """Mean |product| of contributions for pairs of the top features: both values are in the
    row, so nothing is joined. The top list is at most `top` names."""
    names = [r["feature"] for r in global_attributions(df).orderBy(_c("mean_abs").desc(), "feature").limit(top).collect()]
    pairs = [(a, b) for a, b in combinations(names, 2)]
    row = df.agg(*[F.avg(F.abs(_value(a) * _value(b))).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    items = [F.struct(F.lit(f"{a} x {b}").alias("pair"), _c(f"p{i}").alias("strength")) for i, (a, b) in enumerate(pairs)]
    return row.select(F.explode(F.array(*items)).alias("r")).select("r.*")


def attributions_by_half(df: DataFrame, column: str) -> DataFrame:
    """Mean absolute contribution below and above the median of a column."""
    mid = column_quantiles(df, [column], [0.5])[column][0]
    half = F.when(_c(column) <= F.lit(mid), "low").otherwise("high")
    return long_form(df.withColumn("half", half), ["half"]).groupBy("half", "feature").agg(
        F.avg(F.abs("contribution")).alias("mean_abs")
    )


def attributions_by(df: DataFrame, segment: str, p: str = "p", top: int = 10, least_rows: int = 10) -> DataFrame:
    """Top features per segment with more than ten rows, with its size and mean score."""
    sizes = df.groupBy(segment).agg(F.count(F.lit(1)).alias("segment_size"), F.avg(p).alias("mean_probability"))
    means = long_form(df, [segment]).groupBy(segment, "feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"))
    w = Window.partitionBy(segment).orderBy(_c("mean_abs").desc(), "feature")
    return (
        means.withColumn("rank", F.row_number().over(w))
        .where(_c("rank") <= top)
        .join(sizes.where(_c("segment_size") > least_rows), segment)
    )


def waterfall(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Running start and end over the ranked contributions of a row."""
    steps = F.transform(
        F.sequence(F.lit(1), F.size("ranking")),
        lambda i: F.struct(
            i.alias("position"),
            F.element_at("ranking", i)["feature"].alias("feature"),
            F.aggregate(F.slice("ranking", F.lit(1), i - 1), F.lit(0.0), lambda acc, a: acc + a["contribution"]).alias("start"),
            F.aggregate(F.slice("ranking", F.lit(1), i), F.lit(0.0), lambda acc, a: acc + a["contribution"]).alias("end"),
        ),
    )
    rows = df.where(F.size("ranking") > 0).select(*keys, F.explode_outer(steps).alias("s"))
    return rows.select(*keys, "s.position", "s.feature", F.round("s.start", 6).alias("start"), F.round("s.end", 6).alias("end"))


def segment_comparison(df: DataFrame, key: str, segment: str, features: Sequence[str], top: int = 10) -> DataFrame:
    """Row values against the segment means, the largest differences first. The segment table
    has one row per segment and is joined as the sizes at run time suggest."""
    means = df.groupBy(segment).agg(*[F.avg(_c(f).cast("double")).alias(f"__m_{f}") for f in features])
    items = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                _c(f).cast("double").alias("value"),
                _c(f"__m_{f}").alias("segment_average"),
                (_c(f) - _c(f"__m_{f}")).alias("contribution"),
            )
            for f in features
        ]
    )
    joined = df.join(means, segment).select(key, segment, F.slice(ranked(items), 1, top).alias("r"))
    rows = joined.select(key, segment, F.posexplode_outer("r").alias("pos", "s"))
    pct = F.when(_c("s.segment_average") != 0, _c("s.contribution") / _c("s.segment_average") * 100).otherwise(F.lit(0.0))
    return rows.select(
        key, segment, (_c("pos") + 1).alias("position"), "s.feature", "s.value", "s.segment_average",
        _c("s.contribution").alias("difference"), pct.alias("pct_difference"),
    )


def counterfactual(
    df: DataFrame, coef: Mapping[str, float], intercept: float, means: Mapping[str, float], target: float = 0.3, changes: int = 3
) -> DataFrame:
    """Lower the strongest positive contributors by 30 % (.5 if zero) while that lowers the
    score, up to `changes` of them; changes accumulate and scores are probabilities.

    For a linear score a change moves the logit by coef · step, whatever came before, so the
    kept changes are the first ones with a falling move: one filter, no search loop.
    """
    step = lambda v: F.when(v != 0, F.abs(v) * 0.3).otherwise(F.lit(0.5))
    weights = F.create_map(*[F.lit(x) for f, w in coef.items() for x in (f, float(w))])
    tried = F.filter(F.slice(ranked(_c("attributions")), 1, changes + 5), lambda a: a["contribution"] > 0)
    kept = F.filter(tried, lambda a: F.element_at(weights, a["feature"]) > 0)
    taken = F.transform(
        F.slice(kept, 1, changes),
        lambda a: F.struct(
            a["feature"].alias("feature"),
            a["value"].alias("original_value"),
            (a["value"] - step(a["value"])).alias("counterfactual_value"),
            (-F.element_at(weights, a["feature"]) * step(a["value"])).alias("move"),
        ),
    )
    logit = F.aggregate("attributions", F.lit(float(intercept)), lambda acc, a: acc + a["contribution"])
    out = df.withColumns({"changed_features": taken, "__logit": logit})
    moved = F.aggregate("changed_features", F.lit(0.0), lambda acc, a: acc + a["move"])
    out = out.withColumns(
        {"original_score": sigmoid(_c("__logit")), "counterfactual_score": sigmoid(_c("__logit") + moved)}
    ).drop("__logit")
    return out.withColumns(
        {
            "improvement": _c("original_score") - _c("counterfactual_score"),
            "feasible": _c("counterfactual_score") <= target,
        }
    )


def materiality(contribution: Column) -> Column:
    a = F.abs(contribution)
    return first_match([(a > 0.1, "high"), (a > 0.05, "medium")], "low")


def audit_rows(df: DataFrame, keys: Sequence[str], p: str = "p") -> DataFrame:
    """Regulatory factor rows: direction, materiality, decision, and the score sum of the row."""
    total = F.aggregate("ranking", F.lit(0.0), lambda acc, a: acc + a["contribution"])
    rows = df.select(
        *keys,
        F.when(_c(p) < 0.5, "approve").otherwise("decline").alias("decision"),
        F.round(total, 6).alias("risk_score"),
        F.posexplode("ranking").alias("pos", "a"),
    )
    c = _c("a.contribution")
    return rows.select(
        *keys, "decision", "risk_score", (_c("pos") + 1).alias("position"), _c("a.feature").alias("factor"),
        _c("a.value").alias("factor_value"), c.alias("contribution"),
        F.when(c > 0, "adverse").otherwise("favorable").alias("direction"), materiality(c).alias("materiality"),
    )


def _names(column: str, n: int) -> Column:
    return F.transform(F.slice(column, 1, n), lambda a: a["feature"])


def narrative(df: DataFrame, p: str = "p") -> DataFrame:
    """Texts for the committee, the officer, the executive and the customer."""
    prob = _c(p)
    label = first_match([(prob >= 0.6, "High Risk"), (prob >= 0.3, "Medium Risk")], "Low Risk")
    drivers = F.when(F.size("risk_factors") > 0, F.array_join(_names("risk_factors", 3), ", ")).otherwise(
        "none that matter"
    )
    advice = F.when(prob >= 0.5, "review again before a decision").otherwise("approve on the usual terms")
    sentence = lambda text: lambda a: F.format_string(text, humanize(a["feature"]))
    return df.withColumns(
        {
            "committee": F.format_string(
                "%s: the estimated chance of default is %.1f%%. Main drivers: %s. Advice: %s.",
                label, prob * 100, drivers, advice,
            ),
            "officer": officer_action(prob),
            "executive": F.concat_ws(
                "; ",
                F.concat(first_match([(prob < 0.3, "Low"), (prob < 0.6, "Medium")], "High"), F.lit(" risk applicant")),
                executive_action(prob),
                F.array_join(_names("risk_factors", 3), ", "),
            ),
            "customer_outcome": first_match(
                [
                    (prob < 0.3, "The details given support this application."),
                    (prob < 0.6, "We would like to look at some details of this application again."),
                ],
                "The details given raise doubts about this application.",
            ),
            "customer_helped": F.array_join(
                F.transform(F.slice("protective_factors", 1, 3), sentence("%s speaks for you.")), " "
            ),
            "customer_improve": F.array_join(
                F.transform(
                    F.slice("risk_factors", 1, 3),
                    sentence("%s weighs against you."),
                ),
                " ",
            ),
        }
    )


def api_document(df: DataFrame, p: str = "p") -> Column:
    """The nested response of the scoring API as a JSON string."""
    return F.to_json(
        F.struct(
            F.struct(_c(p).alias("probability")).alias("prediction"),
            F.struct(_c("ranking").alias("top_features"), _c("risk_factors"), _c("protective_factors")).alias("explanation"),
        )
    )


def attribution_confidence(attributions: Column) -> Column:
    """1 - population deviation / mean |contribution|, in three words."""
    xs = F.transform(attributions, lambda a: a["contribution"])
    n = F.size(xs)
    total = lambda f: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + f(x))
    mean = total(lambda x: x) / n
    sd = F.sqrt(F.greatest(total(lambda x: x * x) / n - mean * mean, F.lit(0.0)))
    v = 1 - sd / (total(F.abs) / n + F.lit(1e-8))
    return first_match([(v > 0.7, "High confidence"), (v > 0.4, "Medium confidence")], "Low confidence")


def rule_factors(df: DataFrame) -> DataFrame:
    """Risk and protective factors without a model."""
    item = lambda f, impact, v: F.struct(F.lit(f).alias("factor"), impact.alias("impact"), v.cast("double").alias("value"))
    dti, cs, emp = _c("debt_to_income"), _c("credit_score"), _c("employment_length")
    return df.withColumns(
        {
            "risk_factors": F.array(
                item("Debt-to-Income Ratio", F.when(dti > 0.43, "high").otherwise("moderate"), dti),
                item("Credit Score", F.when(cs < 620, "high").otherwise("low"), cs),
            ),
            "protective_factors": F.array_compact(
                F.array(
                    F.when(cs >= 700, item("Credit Score", F.lit("protective"), cs)),
                    F.when(emp >= 5, item("Employment Length", F.lit("protective"), emp)),
                )
            ),
        }
    )


def reason_codes(df: DataFrame, n: int = 5) -> Column:
    return F.array_join(_names("risk_factors", n), ",")


def consistency_report(df: DataFrame, segment: str, p: str = "p", top: int = 15) -> DataFrame:
    """(section, name, value, note) rows: top features with their group, and segment tops."""
    g = global_attributions(df).orderBy(_c("mean_abs").desc(), "feature").limit(top)
    head = g.select(F.lit("global").alias("section"), _c("feature").alias("name"), _c("mean_abs").alias("value"), feature_category(_c("feature")).alias("note"))
    seg = attributions_by(df, segment, p).select(
        F.concat(F.lit("segment:"), _c(segment)).alias("section"), _c("feature").alias("name"), _c("mean_abs").alias("value"),
        F.concat(F.lit("rank "), _c("rank").cast("string")).alias("note"),
    )
    edges = [0.1, 0.25, 0.5, 0.75, 1.0]
    acts = df.sparkSession.range(1).select(
        F.explode(F.array(*[F.struct(F.lit("thresholds").alias("section"), F.lit(f"below {e}").alias("name"), F.lit(e).alias("value")) for e in edges])).alias("r")
    ).select("r.*", recommended_action(_c("r.value") - 0.01).alias("note"))
    return head.unionByName(seg).unionByName(acts)
