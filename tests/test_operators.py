"""Properties, hand-checked cases and brute force for what SQL does not check."""

import math
import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import account as A
from riskloom.operators import drift as D
from riskloom.operators import evaluate as E
from riskloom.operators import graph as G
from riskloom.operators import prep as P
from riskloom.operators import pricing as R
from riskloom.operators.loan import default_label
from riskloom.streaming import jobs as J


def test_price_example(spark):
    row = spark.createDataFrame(
        [(0.15, 500000.0, 60, "personal", "near_prime", 680, 0.35)],
        "default_prob double, loan_amount double, tenure_months int, loan_type string, segment string, credit_score int, dti double",
    )
    assert R.recommend_pricing(row).first()["optimal_rate"] == pytest.approx(0.28)


def test_schedule_repays_the_loan(spark):
    loans = spark.createDataFrame([(1, 500000.0, 0.12, 60), (2, 1000.0, 0.0, 7)], "loan_id bigint, principal double, annual_rate double, tenure_months int")
    out = {r.loan_id: r for r in R.amortization(loans).groupBy("loan_id").agg(F.sum("principal").alias("p"), F.min("balance").alias("b"), F.count("*").alias("n")).collect()}
    assert out[1].n == 60 and out[1].p == pytest.approx(500000, abs=0.5) and out[1].b == 0
    assert out[2].n == 7 and out[2].p == pytest.approx(1000, abs=0.05)


def test_schedule_parts_follow_the_expanded_rows(spark, monkeypatch):
    monkeypatch.setattr(R, "PART_ROWS", 1000, raising=False)
    rows = [(i // 2 if i < 20 else i, 1000.0 + i, 0.1, 60) for i in range(200)] + [(None, 5.0, 0.1, 3), (7, 5.0, 0.1, 0), (8, 5.0, 0.1, None)]
    out = R.amortization(spark.createDataFrame(rows, "loan_id bigint, principal double, annual_rate double, tenure_months int"))
    assert out.rdd.getNumPartitions() == 13
    assert out.count() == 200 * 60 + 3
    last = {r.loan_id: r.p for r in out.groupBy("loan_id").agg(F.max("cumulative_principal").alias("p")).collect()}
    assert last[3] == pytest.approx(2013, abs=1) and last[50] == pytest.approx(1050, abs=1) and last[None] == pytest.approx(5, abs=0.05)
    assert R.amortization(spark.createDataFrame([], "loan_id bigint, principal double, annual_rate double, tenure_months int")).count() == 0


def test_account_quantiles_by_arrays_and_by_slices(tables, monkeypatch):
    t = tables.transactions.where("account_id < 40").withColumn("amount", F.when(F.col("transaction_key") % 9 == 0, float("nan")).when(F.col("transaction_key") % 11 != 0, F.col("amount")))
    t = t.withColumn("account_id", F.when(F.col("account_id") % 10 != 3, F.col("account_id")))
    calls = []
    sliced = A.quantiles
    monkeypatch.setattr(A, "quantiles", lambda *a, **k: calls.append(1) or sliced(*a, **k))
    few = {r.account_id: r for r in A.velocity_features(t).collect()}
    assert not calls  # no slices for small accounts
    monkeypatch.setattr(A, "BUSY_ROWS", 20, raising=False)
    many = {r.account_id: r for r in A.velocity_features(t).collect()}
    assert calls and {k: str(r) for k, r in few.items()} == {k: str(r) for k, r in many.items()}  # NaN is not equal to itself
    assert None in few and any(r.large_txn_count for r in few.values())
    wanted = {"m": ("balance_after", 0.5), "p": ("amount", 0.9)}
    rows = [{(r.account_id, r.m, r.p) for r in f(t, wanted).where("m is not null or p is not null").collect()} for f in (A._row_quantiles, A._slice_quantiles)]
    assert rows[0] == rows[1]


def test_auc_of_reversed_scores(tables):
    s = tables.scored
    a = E.auc_roc(s).first()[0]
    b = E.auc_roc(s.withColumn("p", 1 - F.col("p"))).first()[0]
    assert a + b == pytest.approx(1)


def test_same_data_has_no_drift(tables):
    x = tables.loans.select("loan_amount", "loan_type")
    row = D.data_drift(x, x, ["loan_amount"], ["loan_type"]).collect()
    assert all(r.psi == pytest.approx(0) and not r.drifted for r in row)
    ab = D.ks_2samp(x.where("loan_type = 'auto'"), x.where("loan_type <> 'auto'"), ["loan_amount"]).first()
    ba = D.ks_2samp(x.where("loan_type <> 'auto'"), x.where("loan_type = 'auto'"), ["loan_amount"]).first()
    assert ab.ks_statistic == pytest.approx(ba.ks_statistic)


@pytest.mark.parametrize("threshold", [2.0, 5.0])
def test_page_hinkley_equals_a_loop(spark, threshold):
    rnd = random.Random(5)
    data = [(i, "ref" if i < 150 else "cur", rnd.randint(0, 1), rnd.random() * (0.2 if i < 150 else 1.0)) for i in range(300)]
    df = spark.createDataFrame(data, "seq bigint, side string, label int, pred double")
    got = D.page_hinkley(df, threshold=threshold).first()
    errs = [abs(y - p) for _, _, y, p in data]
    mean, s, low, hit = sum(errs) / len(errs), 0.0, math.inf, None
    for i, e in enumerate(errs):
        s += e - mean - 0.005
        low = min(low, s)
        if s - low > threshold:
            hit = i
            break
    assert got.drift_point == hit
    assert got.page_hinkley_statistic == pytest.approx(s)


def test_split_shares_per_class(tables):
    df = default_label(tables.loans, out="y").select("loan_id", "y")
    parts = P.stratified_split(df, "y", "loan_id").groupBy("y", "part").count().collect()
    total = {y: sum(r["count"] for r in parts if r.y == y) for y in (0, 1)}
    for r in parts:
        want = {"train": 0.65, "val": 0.15, "test": 0.2}[r.part]
        assert abs(r["count"] / total[r.y] - want) < 0.01 + 1.5 / total[r.y]


def test_oversample_reaches_the_ratio(tables):
    df = default_label(tables.loans, out="y").select("loan_id", "y", "credit_score", "debt_to_income")
    out = P.oversample(df, "y", "loan_id", ["credit_score", "debt_to_income"], ratio=0.8)
    n = {r.y: r["count"] for r in out.groupBy("y").count().collect()}
    assert min(n.values()) / max(n.values()) == pytest.approx(0.8, abs=0.08)
    dti = out.where("synthetic").agg(F.min("debt_to_income"), F.max("debt_to_income")).first()
    assert 0 <= dti[0] and dti[1] <= 1


def test_oversample_makes_up_for_missing_features(spark):
    rows = [(i, int(i < 200), None if i < 100 else float(i % 17), float(i % 13)) for i in range(2000)]
    out = P.oversample(spark.createDataFrame(rows, "k long, y int, a double, b double"), "y", "k", ["a", "b"])
    n = {r.y: r["count"] for r in out.groupBy("y").count().collect()}
    assert n[0] == 1800 and n[1] == pytest.approx(1800, rel=0.05)
    assert out.where("synthetic and (a is null or b is null)").isEmpty()


def test_oversample_copies_a_row_without_neighbours(spark):
    rows = [(i, 1, float(i % 7) / 100, float(i % 5) / 100) for i in range(60)] + [(100, 1, 1e6, -1e6)] + [(200 + i, 0, 1.0, 1.0) for i in range(400)]
    out = P.oversample(spark.createDataFrame(rows, "k long, y int, a double, b double"), "y", "k", ["a", "b"])
    made = out.where("synthetic and a > 10").select("a", "b").distinct().collect()
    assert [tuple(r) for r in made] == [(1e6, -1e6)]


def test_folds_hold_each_class_evenly(spark):
    df = spark.range(1003).withColumn("y", (F.col("id") % 7 == 0).cast("int"))
    folds = P.kfold(df, "id", y="y").groupBy("y", "fold").count().collect()
    for y in (0, 1):
        n = [r["count"] for r in folds if r.y == y]
        assert len(n) == 5 and max(n) - min(n) <= 1


def test_power_transform_is_standardised(spark):
    rnd = random.Random(2)
    df = spark.createDataFrame([(math.exp(rnd.gauss(0, 1)),) for _ in range(500)], "x double")
    r = P.power_transform(df, ["x"]).agg(F.avg("x"), F.stddev_pop("x"), F.skewness("x")).first()
    assert r[0] == pytest.approx(0, abs=1e-9) and r[1] == pytest.approx(1) and abs(r[2]) < 0.3


def test_transform_needs_fit(tables):
    with pytest.raises(RuntimeError):
        P.Preprocessor().transform(tables.loans)


def test_components_of_a_long_path(spark):
    edges = [(f"{i:03}", f"{i + 1:03}") for i in range(60)] + [("x", "y")]
    out = {r.node: r.component for r in G.components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert out["060"] == "000" and out["y"] == "x"


def test_stream_drift_equals_a_loop(tables):
    e = J.file_stream(tables.spark, tables.folder, "events.parquet").select(
        "user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 5 == 0).cast("int").alias("label"),
        (F.col("event_id") % 7 / 7.0).alias("pred"),
    )
    got = {r.key: r for r in J.run_to_table(J.stream_drift(e, "user_id", "ts", "label", "pred"), mode="update").collect()}
    rows = tables.events.select("user_id", "ts", "event_id").orderBy("ts").collect()
    for key, r in got.items():
        mine = [x.event_id for x in rows if str(x.user_id) == key]
        n, total, ph, low = 0, 0.0, 0.0, 0.0
        for k in mine:
            err = abs((1 if k % 5 == 0 else 0) - k % 7 / 7.0)
            n, total = n + 1, total + err
            ph += err - total / n - 0.005
            low = min(low, ph)
        assert r.n == n and r.mean_error == pytest.approx(total / n) and r.page_hinkley == pytest.approx(ph - low)


def test_chi2_tail_closed_forms(spark):
    from riskloom.functions.pvalues import chi2_p

    df = spark.createDataFrame([(3.841458820694124, 1), (5.991464547107979, 2), (7.814727903251179, 3)], "x double, k int")
    assert [r[0] for r in df.select(chi2_p(F.col("x"), F.col("k"))).collect()] == pytest.approx([0.05] * 3)


def test_sentiment_of_neutral_text_is_zero(spark):
    from riskloom.functions.text import sentiment

    df = spark.createDataFrame([("the table and the chair of the house",), ("a good and stable house",), (None,)], "s string")
    got = [r.s.polarity for r in df.select(sentiment(F.col("s")).alias("s")).collect()]
    assert got[0] == got[2] == 0 and abs(got[1] - 0.55) < 1e-9


def test_chi_square_tail_with_many_degrees():
    import math

    from riskloom.functions.pvalues import chi2_tail

    assert abs(chi2_tail(2000, 2000) - 0.4958) < 1e-3 and abs(chi2_tail(3.841458820694124, 1) - 0.05) < 1e-12
    for x, k in ((20, 10), (700, 600), (1800, 1700), (2500, 2000)):
        h = x / 2
        assert math.isclose(chi2_tail(x, k), sum(math.exp(i * math.log(h) - h - math.lgamma(i + 1)) for i in range(k // 2)), rel_tol=1e-9)


def test_neighbours_against_all_pairs(spark):
    import numpy as np

    from riskloom.operators.neighbours import nearest_neighbours

    rng = np.random.default_rng(3)
    pts = np.vstack([rng.normal(size=(1500, 2)), np.zeros((300, 2)), rng.normal(5, 0.01, size=(200, 2))])
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(pts)] + [(5000, None, 1.0), (None, 1.0, 1.0), (5001, float("nan"), 0.0)]
    got = {r.k: [n.key for n in r.neighbours] for r in nearest_neighbours(spark.createDataFrame(rows, "k long, a double, b double"), "k", ["a", "b"]).collect()}
    assert set(got) == set(range(len(pts)))
    d = ((pts[:, None, :] - pts[None, :, :]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    hits = total = 0
    for i, found in got.items():
        assert len(found) <= 5 and i not in found
        kth = np.sort(d[i])[4]
        hits += sum(d[i, j] <= kth + 1e-12 for j in found)
        total += 5
    assert hits / total >= 0.9


def test_smote_rows_lie_between_a_row_and_a_near_one(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(i, int(i < 300), float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(2000, 2)))]
    out = P.oversample(spark.createDataFrame(rows, "k long, y int, a double, b double"), "y", "k", ["a", "b"], ratio=1.0)
    made = np.array([(r.a, r.b) for r in out.where("synthetic").collect()])
    assert len(made) == 1700 - 300
    base = np.array([(a, b) for _, y, a, b in rows if y == 1])
    z = (base - base.mean(0)) / base.std(0)
    d = ((z[:, None, :] - z[None, :, :]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :5]
    ok = 0
    for p in made:
        for i in range(len(base)):
            for j in near[i]:
                u, v = p - base[i], base[j] - base[i]
                if abs(u[0] * v[1] - u[1] * v[0]) < 1e-9 and -1e-9 <= u @ v <= v @ v + 1e-9:
                    ok += 1
                    break
            else:
                continue
            break
    assert ok / len(made) >= 0.9


def test_retrain_cycle_actions(tables):
    from riskloom.plans.models import retrain_cycle_log

    reg, log = retrain_cycle_log(tables)
    rows = sorted(log.collect(), key=lambda r: r.seq)
    assert [r.action for r in rows] == ["skip", "replaced", "replaced", "kept", "rollback", "rollback"]
    assert [r.pointer_moved for r in rows] == [False, True, True, False, True, True]
    assert rows[2].new_auc > rows[2].old_auc and rows[3].new_auc == pytest.approx(rows[3].old_auc, abs=1e-3)
    full = sorted(reg.log().collect(), key=lambda r: r.seq)
    first, second = full[1].version_after, full[2].version_after
    assert full[4].version_after == first and full[5].version_after == second and reg.current() == second
    assert reg.load() is not None and reg.load(first) is not None


def _newton(x, y, w, lam):
    import numpy as np

    xt = np.hstack([np.ones((len(x), 1)), x])
    b = np.zeros(xt.shape[1])
    pen = np.ones(xt.shape[1])
    pen[0] = 0
    for _ in range(100):
        p = 1 / (1 + np.exp(-(xt @ b)))
        g = xt.T @ (w * (p - y)) / w.sum() + lam * pen * b
        h = (xt * (w * p * (1 - p))[:, None]).T @ xt / w.sum() + lam * np.diag(pen)
        step = np.linalg.solve(h, g)
        b -= step
        if np.abs(step).max() < 1e-12:
            break
    return b


def test_grouped_logistic_equals_single_fits(spark, tables):
    import numpy as np

    from riskloom.operators.grouped import fit_logistic_groups, score_groups

    feats = ["credit_score", "debt_to_income", "months_since_issue"]
    schema = "loan_type string, y int, credit_score double, debt_to_income double, months_since_issue double"
    base = default_label(tables.loans, out="y").selectExpr(*[f"cast({c.split()[0]} as {c.split()[1]}) as {c.split()[0]}" for c in schema.split(", ")])
    extra = spark.createDataFrame([(None, i % 2, 600.0 + i, 0.1 * (i % 7), float(i % 30)) for i in range(150)] + [("one", 1, 700.0, 0.2, 3.0)] * 120, schema)
    df = base.unionByName(extra)
    models = {r.loan_type: r for r in fit_logistic_groups(df, "loan_type", feats, least_rows=100).collect()}
    rows = df.collect()
    assert not models["one"].fitted and models["one"].coefficients is None
    checked = 0
    for key, m in models.items():
        part = [r for r in rows if r.loan_type == key and r.y is not None]
        if not m.fitted:
            assert len(part) < 100 or len({r.y for r in part}) < 2
            continue
        x = np.array([[r[f] if r[f] is not None else 0.0 for f in feats] for r in part], dtype=float)
        y = np.array([r.y for r in part], dtype=float)
        n1 = y.sum()
        w = np.where(y == 1, len(y) / (2 * n1), len(y) / (2 * (len(y) - n1)))
        want = _newton(x, y, w, 1.0 / len(y))
        got = np.array([m.intercept, *m.coefficients])
        assert np.abs(got - want).max() <= 1e-6 * max(1.0, np.abs(want).max())
        checked += 1
    assert checked >= 2
    p = score_groups(df, fit_logistic_groups(df, "loan_type", feats), "loan_type", feats)
    assert p.where("loan_type = 'one'").where("p is not null").count() == 0 and p.where("p is not null").count() > 0


def test_concentration_sets_levels_and_shocks(spark):
    from riskloom.operators.series import concentration_sets

    rows = [("a", "x", 100.0, 10.0), ("a", "y", 50.0, 49.0), ("b", "x", 50.0, 5.0), (None, "x", None, 1.0), ("b", None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "t string, s string, amount double, loss double")
    out = concentration_sets(df, ["t", "s"], [["t"], ["t", "s"], []], "amount", "loss", shocks_bps=(0, 200), top_n=1).collect()
    by = {(r.level, r.t, r.s, r.shock_bps): r for r in out}
    assert by[("ALL", None, None, 0)].exposure == 200 and by[("ALL", None, None, 0)].loans == 5
    assert by[("t", "a", None, 0)].share == pytest.approx(0.75) and by[("t", "a", None, 0)].top and by[("t", "a", None, 0)].rank == 1
    assert by[("t", "a", None, 0)].hhi == pytest.approx(0.75**2 + 0.25**2)
    assert by[("t", "a", None, 200)].expected_loss == pytest.approx(10 * 1.2 + 50)  # the second row is capped at its exposure
    assert by[("t", None, None, 0)].loans == 1 and len({r.level for r in out}) == 3


def test_range_counts_edges(spark):
    import datetime as dt

    from riskloom.operators.series import range_counts

    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, "a", t0), (2, "a", t0 + dt.timedelta(days=30)), (3, "a", t0 + dt.timedelta(days=30)), (4, "a", t0 + dt.timedelta(days=30, microseconds=1)),
            (5, None, t0), (6, None, t0 + dt.timedelta(days=1)), (7, "b", None), (8, "a", t0 + dt.timedelta(days=61))]
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp")
    got = {r.id: (r.n_in_range, r.spike) for r in range_counts(df, "k", "ts").collect()}
    assert got[1] == (1, False) and got[2] == (3, True) and got[3] == (3, True) and got[4] == (3, True)
    assert got[5] == (1, False) and got[6] == (2, False) and got[7] == (None, None) and got[8] == (1, False)
