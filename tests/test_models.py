"""Kernels, models and harnesses against closed forms, definitions and simulation."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlstone.operators import kernels as K
from marlstone.operators.harness import permutation_p, simulated_power, spearman_permutation, walk_forward
from marlstone.operators.models import boosted_against_logit, evt_labels, grouped_logit, grouped_quantiles, pooled_logit


def data(seed, n=400, b=(-1.5, 0.8, -0.4)):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, len(b) - 1))
    y = (rng.random(n) < K.sigmoid(b[0] + x @ np.array(b[1:]))).astype(float)
    return x, y


def test_logit_solves_its_equations():
    x, y = data(1)
    d = K.with_constant(x)
    b, cov, ll = K.fit_logit(d, y)
    assert np.abs(d.T @ (y - K.sigmoid(d @ b))).max() < 1e-6
    assert np.allclose(b, [-1.5, 0.8, -0.4], atol=0.4) and (np.diag(cov) > 0).all() and ll < 0
    ridge = K.fit_logit(d, y, ridge=50.0)[0]
    assert np.abs(ridge[1:]).sum() < np.abs(b[1:]).sum()


def test_separated_data_stay_finite():
    x = np.arange(20.0)[:, None]
    assert np.isfinite(K.fit_logit(K.with_constant(x), (x[:, 0] > 9).astype(float))[0]).all()
    assert np.isfinite(K.fit_firth(K.with_constant(K.zscore(x)), (x[:, 0] > 9).astype(float))[0]).all()


def test_firth_test_keeps_its_size_and_the_compat_form_does_not():
    rejected = {False: 0, True: 0}
    for s in range(150):
        rng = np.random.default_rng(s)
        x = K.with_constant(rng.standard_normal((150, 2)))
        y = (rng.random(150) < 0.08).astype(float)
        if 3 <= y.sum():
            for compat in rejected:
                rejected[compat] += K.firth_test(x, y, 1, compat)[2] < 0.05
    assert rejected[False] <= 18 < rejected[True]


def test_auc_is_the_share_of_pairs():
    rng = np.random.default_rng(3)
    y, p = (rng.random(60) < 0.4).astype(float), np.round(rng.random(60), 1)
    pairs = [(a > b) + 0.5 * (a == b) for a, b in itertools.product(p[y == 1], p[y == 0])]
    assert K.auc(y, p) == pytest.approx(np.mean(pairs)) and K.auc(y, -p) == pytest.approx(1 - np.mean(pairs))


@pytest.mark.parametrize("tau", [0.1, 0.5, 0.9])
def test_quantile_regression_covers_tau(tau):
    rng = np.random.default_rng(4)
    x = K.with_constant(rng.standard_normal((2000, 1)))
    y = x @ np.array([1.0, 2.0]) + rng.standard_normal(2000)
    b, se = K.quantile_regression(x, y, tau)
    assert np.mean(y <= x @ b) == pytest.approx(tau, abs=0.01) and b[1] == pytest.approx(2, abs=0.15) and 0 < se[1] < 0.2


@pytest.mark.parametrize("shape", [-0.3, 0.0, 0.4])
def test_gpd(shape):
    u = np.random.default_rng(5).random(4000)
    x = 2 * (u**-shape - 1) / shape if shape else -2 * np.log(u)
    c, s = K.fit_gpd(x)
    assert c == pytest.approx(shape, abs=0.08) and s == pytest.approx(2, rel=0.1)
    assert K.gpd_tail(np.array([0.0]), c, s)[0] == pytest.approx(1)


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1500, 3))
    y = (rng.random(1500) < np.where((x[:, 0] > 0) == (x[:, 1] > 0), 0.8, 0.2)).astype(float)
    model = K.grow_trees(x[:1000], y[:1000])
    assert K.auc(y[1000:], K.predict_trees(model, x[1000:])) > 0.7


def frame(spark, seed=7, n=600, groups=3):
    x, y = data(seed, n)
    rng = np.random.default_rng(seed)
    return spark.createDataFrame(pd.DataFrame({"g": [f"g{k % groups}" for k in range(n)], "t": pd.to_datetime("2020-01-03") + pd.to_timedelta(7 * np.arange(n), unit="D"), "a": x[:, 0], "b": x[:, 1], "y": y.astype(int), "z": x[:, 0] + rng.standard_normal(n)})).withColumn("t", F.to_date("t"))


def test_pooled_equals_local_fit(spark):
    df = frame(spark)
    pdf = df.toPandas()
    b, cov, _ = K.fit_logit(K.with_constant(K.zscore(pdf[["a", "b"]].to_numpy())), pdf["y"].to_numpy(dtype=float))
    got = {r.feature: r for r in pooled_logit(df, "y", ["a", "b"]).collect()}
    assert math.log(got["a"].odds_ratio) == pytest.approx(b[1], abs=1e-6)
    assert math.log(got["a"].hi) == pytest.approx(b[1] + 1.959964 * math.sqrt(cov[1, 1]), abs=1e-6)
    fe = {r.feature: r for r in pooled_logit(df, "y", ["a", "b"], clusters=["g", "t"], fixed_effects="g").collect()}
    assert fe["a"].n == len(pdf) and fe["a"].lo < fe["a"].odds_ratio < fe["a"].hi
    single = {r.feature: r for r in pooled_logit(df.withColumn("row", F.monotonically_increasing_id()), "y", ["a"], clusters=["row"]).collect()}
    design = K.with_constant(K.zscore(pdf[["a"]].to_numpy()))
    beta, c, _ = K.fit_logit(design, pdf["y"].to_numpy(dtype=float))
    s = design * (pdf["y"].to_numpy() - K.sigmoid(design @ beta))[:, None]
    n = len(pdf)
    robust = c @ (s.T @ s) @ c * (n / (n - 1)) * ((n - 1) / (n - 2))
    assert math.log(single["a"].hi / single["a"].odds_ratio) == pytest.approx(1.959964 * math.sqrt(robust[1, 1]), rel=1e-5)
    assert pooled_logit(df.limit(0), "y", ["a"]).count() == 0


def test_grouped(spark):
    df = frame(spark)
    rows = grouped_logit(df, ["g"], "y", ["a", "b"]).collect()
    assert {r.g for r in rows} == {"g0", "g1", "g2"} and all(r.odds_ratio > 1 for r in rows if r.feature == "a")
    assert grouped_logit(df.filter("y = 0"), ["g"], "y", ["a"]).count() == 0
    q = grouped_quantiles(df, ["g"], "z", ["a"]).collect()
    assert len(q) == 12 and all(abs(r.coefficient - 1) < 0.5 for r in q)
    assert boosted_against_logit(df, ["g"], "t", "y", ["a", "b"]).count() == 3
    e = evt_labels(df, ["g"], "t", "z").groupBy("tail_label").count().collect()
    assert {r.tail_label for r in e} == {-1, 0, 1} and sum(r["count"] for r in e) == 600


def walk_frame(spark, seed=8, n=160):
    rng = np.random.default_rng(seed)
    r = rng.standard_normal(n + 1) * 0.05
    return pd.DataFrame({"g": "one", "t": pd.to_datetime("2020-01-03") + pd.to_timedelta(7 * np.arange(n), unit="D"), "ret_1w": r[:-1], "ret_1w_fwd": r[1:], "scar": rng.random(n) < 0.8, "a": rng.standard_normal(n), "b": rng.standard_normal(n)})


def run_walk(spark, pdf, **options):
    df = spark.createDataFrame(pdf).withColumn("t", F.to_date("t"))
    return {(r.spec, r.half_life, r.t): (r.y, r.p, r.n_train) for r in walk_forward(df, "g", "t", {"ab": ["a", "b"], "a": ["a"]}, (52.0, 1e9), **options).collect()}


def test_walk_forward_sees_no_future(spark):
    pdf = walk_frame(spark)
    base = run_walk(spark, pdf)
    assert base and {k[0] for k in base} == {"a", "ab"} and run_walk(spark, pdf, block=7) == base
    cut = pdf["t"].iloc[110]
    changed = pdf.copy()
    late = changed.index > 110 - 4  # outcomes of the last weeks before the step are not known at it
    changed.loc[late, "ret_1w_fwd"] = 9.0
    changed.loc[changed.index > 110, ["ret_1w", "a", "b"]] = 5.0
    other = run_walk(spark, changed)
    for k, (_, p, n) in base.items():
        if pd.Timestamp(k[2]) <= cut:
            if pd.Timestamp(k[2]) == cut:
                assert other[k][1] == pytest.approx(p, abs=1e-12)
            assert other[k][2] == n
    leaky = run_walk(spark, pdf, embargo=0)
    assert min(n for _, _, n in leaky.values()) >= 60


def test_permutation(spark):
    df = frame(spark, n=240)
    p = {r.g: r for r in permutation_p(df, ["g"], "t", "y", ["a", "b"], replicates=60).collect()}
    assert len(p) == 3 and all(1 / 61 <= r.p <= 1 and r.replicates == 60 for r in p.values())
    blocks = permutation_p(df, ["g"], "t", "y", ["a"], replicates=30, block=8, firth=False).collect()
    assert all(r.replicates == 30 for r in blocks)
    rho = spearman_permutation(df, ["g"], "a", "z", replicates=200).collect()
    assert all(r.rho > 0.3 and r.p < 0.05 for r in rho)
    assert permutation_p(df.limit(0), ["g"], "t", "y", ["a"]).count() == 0


def test_power_rises(spark):
    rows = {(r.n, r.odds_ratio): r.power for r in simulated_power(spark, [(150, 0.1, 1.0), (150, 0.1, 2.5), (600, 0.1, 2.5)], reps=80).collect()}
    assert rows[150, 1.0] < 0.15 < rows[150, 2.5] < rows[600, 2.5]


def test_closed_form_size_equals_published_values(spark):
    """At the event rate 18/273 the published sizes for odds ratios 1.3, 1.5, 1.7, 2.0 are 1851, 775, 453, 265."""
    p = 18 / 273
    z = 1.959964 + 0.841621
    assert [round(z * z / (p * (1 - p) * math.log(o) ** 2)) for o in (1.3, 1.5, 1.7, 2.0)] == [1851, 775, 453, 265]


def test_required_size_and_odds_ratio(spark):
    from marlstone.operators.harness import bisected_n, smallest_detectable
    from marlstone.plans import inference as I

    closed = lambda o: (1.959964 + 0.841621) ** 2 / (0.0659 * (1 - 0.0659) * math.log(o) ** 2)
    for o, n in bisected_n(spark, 0.0659, [1.3, 2.0], hi=5000, reps=150):
        assert n == pytest.approx(closed(o), rel=0.3)
    assert bisected_n(spark, 0.0659, [1.05], hi=400, reps=50) == [(1.05, None)]
    assert 1.8 <= dict(smallest_detectable(spark, 0.0659, [273], list(I.MDE_GRID), reps=100))[273] <= 2.4
    assert smallest_detectable(spark, 0.0659, [60], [1.1, 1.2], reps=50) == [(60, None)]
    assert I.POWER_REPS == 600 and I.MDE_GRID[0] == 1.1 and I.MDE_GRID[-1] == 6.0 and len(I.MDE_GRID) == 50 and set(I.ODDS_RATIOS) == {1.3, 1.5, 1.7, 2.0}


def test_in_sample_fits_every_feature_of_the_spec(spark):
    from marlstone.operators.harness import in_sample

    rng = np.random.default_rng(4)
    n = 300
    x = rng.standard_normal((n, 2))
    r = rng.standard_normal(n)
    fwd = -1.5 * x[:, 1] + 0.3 * rng.standard_normal(n)
    rows = pd.DataFrame({"a": "k", "week": pd.date_range("2020-01-03", periods=n, freq="7D").date, "ret_1w": r, "ret_1w_fwd": fwd, "scar": True, "u": x[:, 0], "v": x[:, 1]})
    got = in_sample(spark.createDataFrame(rows), "a", "week", {"both": ["u", "v"], "first": ["u"]}).toPandas()
    y = (fwd <= np.quantile(r, 0.1)).astype(float)
    for spec, cols in (("both", [0, 1]), ("first", [0])):
        d = K.with_constant(K.zscore(x[:, cols]))
        g = got[got.spec == spec].sort_values("week")
        assert (g.y == y).all() and np.allclose(g.p, K.sigmoid(d @ K.fit_logit(d, y, ridge=1.0)[0]))
    auc = {s: K.auc(g.y.to_numpy(), g.p.to_numpy()) for s, g in got.groupby("spec")}
    assert auc["both"] > 0.9 > auc["first"] + 0.2


def test_registered_counts_are_the_references(monkeypatch):
    from marlstone.plans import inference as I
    from marlstone.plans import study

    asked = {}
    for module, name in ((I, "permutation_p"), (I, "spearman_permutation"), (I, "boosted_against_logit"), (I, "walk_forward"), (study, "bootstrap_means")):
        monkeypatch.setattr(module, name, lambda *a, name=name, **k: asked.setdefault((name, k.get("block")), (a, k)))
    for module in (I, study):
        for name in ("features", "assets", "durable", "decile_events", "abnormal_returns", "window_sums", "trailing_join", "_ar"):
            if hasattr(module, name):
                monkeypatch.setattr(module, name, lambda *a, **k: Any())
    monkeypatch.setattr(I, "F", Any())
    for query in (I.m6_permutation, I.m7_blocks, I.m12_boosted, I.m13_spearman, I.h1_walk_forward, study.e9_bootstrap):
        query(None, "")
    assert asked["permutation_p", None][1]["replicates"] == 5000 and asked["permutation_p", 8][1]["replicates"] == 3000
    assert asked["spearman_permutation", None][1]["replicates"] == 20_000 and asked["boosted_against_logit", None][1]["rounds"] == 300
    assert asked["bootstrap_means", None][1]["replicates"] == 10_000 and asked["walk_forward", None][0][4] == (26.0, 52.0, 104.0, 208.0, 1e9)


def test_split_trains_before_and_scores_after(spark, folder):
    from marlstone.operators.models import split_logit
    from marlstone.plans.inference import QUERIES

    x, y = data(7)
    weeks = pd.date_range("2020-01-03", periods=len(y), freq="7D")
    y[300:] = data(8)[1][:100]
    rows = pd.DataFrame({"k": "a", "week": weeks.date, "y": y.astype(int), "u": x[:, 0], "v": x[:, 1] * np.where(np.arange(len(y)) < 300, 1, 40)})
    got = split_logit(spark.createDataFrame(rows), ["k"], "week", "y", ["u", "v"], str(weeks[299].date())).collect()[0]
    a = rows[["u", "v"]].to_numpy()
    mean, sd = a[:300].mean(axis=0), a[:300].std(axis=0)
    beta = K.fit_logit(K.with_constant((a[:300] - mean) / sd), y[:300])[0]
    assert (got.n_train, got.n_test, got.events_train) == (300, 101, int(y[:300].sum()))
    assert got.auc == pytest.approx(K.auc(y[299:], K.with_constant((a[299:] - mean) / sd) @ beta))
    assert split_logit(spark.createDataFrame(rows), ["k"], "week", "y", ["u", "v"], "2019-01-01").count() == 0
    assert "m3_after" in QUERIES


class Any:
    """Stands for any table or column."""

    def __getattr__(self, name):
        return self

    def __call__(self, *a, **k):
        return self


def test_effects_of_many_levels_equal_dummies(spark):
    """Eliminated effects give the coefficient and the errors of a fit with one dummy a level; weights and a level without variation included."""
    rng = np.random.default_rng(11)
    n, levels = 3000, 60
    g, x = rng.integers(0, levels, n), rng.standard_normal((n, 2))
    y = (rng.random(n) < K.sigmoid(rng.standard_normal(levels)[g] - 0.5 + x @ np.array([0.7, -0.3]))).astype(float)
    g[:20], y[:20] = levels, 0.0  # never an event: says nothing of the features
    w, t = rng.random(n) + 0.5, rng.integers(0, 40, n)
    df = spark.createDataFrame(pd.DataFrame({"g": g, "t": t, "a": x[:, 0], "b": x[:, 1], "y": y.astype(int), "w": w}))
    use = g < levels
    z = K.zscore(x)[use]
    design = np.column_stack([z, (g[use][:, None] == np.arange(levels)).astype(float)])
    b = np.zeros(design.shape[1])
    for _ in range(60):
        p = K.sigmoid(design @ b)
        h = (design * (w[use] * p * (1 - p))[:, None]).T @ design
        b = b + np.linalg.solve(h, design.T @ (w[use] * (y[use] - p)))
    got = {r.feature: r for r in pooled_logit(df, "y", ["a", "b"], fixed_effects="g", weight="w").collect()}
    assert got["a"].n == n and got["a"].converged
    cov = np.linalg.inv(h)
    for j, name in enumerate("ab"):
        assert math.log(got[name].odds_ratio) == pytest.approx(b[j], abs=1e-6)
        assert math.log(got[name].hi / got[name].odds_ratio) == pytest.approx(1.959964 * math.sqrt(cov[j, j]), rel=1e-5)
    e = (design * (w[use] * (y[use] - p))[:, None])

    def middle(ids):
        sums = np.array([e[ids == k].sum(axis=0) for k in np.unique(ids)])
        return sums.T @ sums * len(sums) / (len(sums) - 1) * (n - 1) / (n - 2 - levels)

    robust = cov @ (middle(g[use]) + middle(t[use]) - middle(g[use] * 1000 + t[use])) @ cov
    both = {r.feature: r for r in pooled_logit(df, "y", ["a", "b"], clusters=["g", "t"], fixed_effects="g", weight="w").collect()}
    assert math.log(both["a"].hi / both["a"].odds_ratio) == pytest.approx(1.959964 * math.sqrt(robust[0, 0]), rel=1e-5)
    separated = df.withColumn("y", (df["a"] > 0).cast("int"))
    assert not pooled_logit(separated, "y", ["a"], iterations=12).first().converged
    assert pooled_logit(df.withColumn("y", F.lit(1)), "y", ["a"]).count() == 0


def test_walk_forward_waits_until_outcomes_are_known(spark):
    pdf = walk_frame(spark)
    pdf["known"] = pdf["t"] + pd.to_timedelta(7 * 3, unit="D")
    base = run_walk(spark, pdf, known="known")
    assert all(n == (pd.Timestamp(t) - pdf["t"].iloc[0]).days // 7 - 2 for (_, _, t), (_, _, n) in base.items())
    pdf.loc[50, "known"] = pd.NaT
    assert all(n == (pd.Timestamp(t) - pdf["t"].iloc[0]).days // 7 - 3 for (_, _, t), (_, _, n) in run_walk(spark, pdf, known="known").items())


def test_fits_by_group_equal_local_fits(spark):
    from marlstone.operators.models import pooled_fits, pooled_report, predicted

    df = frame(spark, n=500)
    pdf = df.toPandas()
    fits = pooled_fits(df, "g", "y", ["a", "b"])
    firth = pooled_fits(df, "g", "y", ["a", "b"], firth=True)
    null = pooled_fits(df, "g", "y", ["a", "b"], firth=True, fixed=1)
    report = {(r.g, r.feature): r for r in pooled_report(df, "g", "y", ["a", "b"]).collect()}
    scored = predicted(df, "g", ["a", "b"], fits).toPandas()
    for g, part in pdf.groupby("g"):
        design, y = K.with_constant(K.zscore(part[["a", "b"]].to_numpy())), part["y"].to_numpy(dtype=float)
        b, cov, ll = K.fit_logit(design, y)
        assert fits[g]["b"] == pytest.approx(b, abs=1e-6) and fits[g]["ll"] == pytest.approx(ll, abs=1e-6) and fits[g]["converged"]
        assert report[g, "x1"].z == pytest.approx(b[1] / math.sqrt(cov[1, 1]), abs=1e-5) and report[g, "x1"].auc == pytest.approx(K.auc(y, design @ b), abs=1e-9)
        assert scored[scored.g == g]["p"].sum() == pytest.approx(y.sum(), abs=1e-5)
        beta, stat, _ = K.firth_test(design, y, 1)
        assert firth[g]["b"][1] == pytest.approx(beta, abs=1e-6) and 2 * (firth[g]["ll"] - null[g]["ll"]) == pytest.approx(stat, abs=1e-6) and null[g]["b"][1] == 0
    assert pooled_fits(df.limit(0), "g", "y", ["a"]) == {} and pooled_report(df.filter("y = 1"), "g", "y", ["a"]).count() == 0


def test_normal_tail_and_label_methods(spark):
    from marlstone.operators.events import two_sided_p
    from marlstone.operators.labels import tail_labels

    zs = [0.0, 0.3, -1.0, 1.959964, 3.5, -6.0, 7.9, 8.5, 1e9, None, float("nan")]
    for r in spark.createDataFrame([(z,) for z in zs], "z double").select("z", two_sided_p(F.col("z")).alias("p")).collect():
        assert r.p is None if r.z is None or r.z != r.z else r.p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), abs=1e-13)
    df = frame(spark, n=300).withColumnRenamed("g", "coin").withColumnRenamed("t", "week")
    for method in ("quantile", "global_z", "evt"):
        assert {-1, 1} <= {r.tail_label for r in tail_labels(df, "z", method=method).collect()}
