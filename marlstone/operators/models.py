"""Models on feature tables: one small model per group, and pooled ones fitted on all rows by distributed sums."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.timestamps import pin
from marlstone.operators import kernels as K
from marlstone.operators.metrics import metrics
from marlstone.session import durable, small_side


def grouped_logit(df: DataFrame, keys: list[str], y: str, x: list[str], firth: bool = False, compat: bool = False, least_rows: int = 10, least_events: int = 2) -> DataFrame:
    """A z-scored logit per key: n, events, odds ratio per deviation of each feature, its p, AUC and McFadden's R2.

    One row per key and feature. Rows with a NULL are left out; keys with fewer rows or events (or
    non-events) than asked give none. ``firth`` uses the penalised fit and likelihood-ratio test.
    """
    kinds = dict(df.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "n bigint", "events bigint", "feature string", "odds_ratio double", "p double", "auc double", "mcfadden double"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        target = pdf[y].to_numpy(dtype=float)
        events = int(target.sum())
        if len(pdf) < least_rows or min(events, len(pdf) - events) < least_events:
            return pd.DataFrame(columns=[*keys, "n", "events", "feature", "odds_ratio", "p", "auc", "mcfadden"])
        design = K.with_constant(K.zscore(pdf[x].to_numpy(dtype=float)))
        b, cov, ll = K.fit_logit(design, target)
        rate = target.mean()
        null = len(target) * (rate * math.log(rate) + (1 - rate) * math.log(1 - rate))
        score = K.auc(target, design @ b)
        rows = []
        for j, name in enumerate(x, start=1):
            if firth:
                beta, _, p = K.firth_test(design, target, j, compat)
            else:
                beta, p = b[j], K.normal_p(b[j] / math.sqrt(cov[j, j])) if cov[j, j] > 0 else math.nan
            rows.append([*[pdf[k].iloc[0] for k in keys], len(pdf), events, name, math.exp(min(beta, 700)), p, score, 1 - ll / null])
        return pd.DataFrame(rows, columns=[*keys, "n", "events", "feature", "odds_ratio", "p", "auc", "mcfadden"])

    return df.select(*keys, y, *x).na.drop().groupBy(*keys).applyInPandas(fit, schema)


def split_logit(df: DataFrame, keys: list[str], order: str, y: str, x: list[str], split: str, least_events: int = 3) -> DataFrame:
    """AUC per key after a date of a logit fitted to the rows up to it, both ends included: n_train, events_train, n_test, events_test, auc.

    Features are scaled by the training rows' moments. Keys with fewer training events, no training
    non-event or one class only after the date give no row.
    """
    kinds = dict(df.dtypes)
    names = [*keys, "n_train", "events_train", "n_test", "events_test", "auc"]
    day = pd.Timestamp(split)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        when = pd.to_datetime(pdf[order])
        a, b = pdf[when <= day], pdf[when >= day]
        ya, yb = a[y].to_numpy(dtype=float), b[y].to_numpy(dtype=float)
        if ya.sum() < least_events or ya.sum() == len(ya) or yb.sum() in (0, len(yb)):
            return pd.DataFrame(columns=names)
        xa, xb = a[x].to_numpy(dtype=float), b[x].to_numpy(dtype=float)
        mean, sd = xa.mean(axis=0), xa.std(axis=0)
        beta = K.fit_logit(K.with_constant(K.zscore(xa, mean, sd)), ya)[0]
        score = K.auc(yb, K.with_constant(K.zscore(xb, mean, sd)) @ beta)
        return pd.DataFrame([[*[pdf[k].iloc[0] for k in keys], len(a), int(ya.sum()), len(b), int(yb.sum()), score]], columns=names)

    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "n_train bigint", "events_train bigint", "n_test bigint", "events_test bigint", "auc double"])
    return df.select(*keys, order, y, *x).na.drop().groupBy(*keys).applyInPandas(fit, schema)


def _products(names: list[str]) -> list[tuple[str, str]]:
    """The pairs of a symmetric matrix, one of each."""
    return [(a, b) for i, a in enumerate(names) for b in names[i:]]


def _matrix(row, names: list[str], prefix: str) -> np.ndarray:
    m = np.zeros((len(names), len(names)))
    for a, b in _products(names):
        i, j = names.index(a), names.index(b)
        m[i, j] = m[j, i] = row[f"{prefix}{i}_{j}"] or 0.0
    return m


def _cross(names: list[str], prefix: str, by: Column) -> list[Column]:
    return [F.sum(F.col(a) * F.col(b) * by).alias(f"{prefix}{names.index(a)}_{names.index(b)}") for a, b in _products(names)]


def pooled_logit(df: DataFrame, y: str, x: list[str], clusters: list[str] | None = None, fixed_effects: str | None = None, weight: str | None = None, ridge: float = 0.0, iterations: int = 50, tolerance: float = 1e-8) -> DataFrame:
    """Logit on all rows with optional fixed effects and cluster-robust errors: feature, odds_ratio, lo, hi, p, n, events, converged.

    Newton steps on sums of built-in aggregates with map-side combining: k x k numbers for k features
    reach the driver a step, however many rows and levels there are. Features are per deviation.

    Fixed effects are eliminated: each step sums by level, a level's own effect is solved for given
    the features' (the Schur complement of its diagonal block), and only the table of levels, which
    is cut by a checkpoint, carries the effects to the next step. So any number of levels is exact.
    Levels whose outcome never varies have an infinite effect and say nothing of the features; their
    rows count in n and events. ``ridge`` penalises the features, not constant or effects.

    Errors: model-based; with one of ``clusters`` the sandwich over its groups; with two, both minus
    their intersection (features freed of the effects first, which gives the same block as all
    dummies do); with (G / (G - 1)) ((n - 1) / (n - k)), k with the effects. Rows with a NULL are left
    out; without any row, or without both outcomes, the result is empty. ``converged`` tells whether
    the last step was below ``tolerance``: separated data never get there.
    """
    groups = clusters or []
    if not fixed_effects:  # the constant is one more feature then, unpenalised and not reported
        x = [*x, "__one"]
        df = df.withColumn("__one", F.lit(1.0))
    use = df.select(F.col(y).cast("double").alias("__y"), *[F.col(c).cast("double").alias(f"__r{k}") for k, c in enumerate(x)], *[F.col(c).alias(f"__c{k}") for k, c in enumerate(groups)], *([F.col(fixed_effects).alias("__g")] if fixed_effects else []), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("__w"))
    use = durable(use.na.drop())
    schema = "feature string, odds_ratio double, lo double, hi double, p double, n bigint, events bigint, converged boolean"
    head = use.agg(F.count("*").alias("n"), F.sum("__y").alias("events"), *[F.avg(f"__r{k}").alias(f"m{k}") for k in range(len(x))], *[F.stddev_pop(f"__r{k}").alias(f"s{k}") for k in range(len(x))]).first()
    n, events = head["n"], head["events"] or 0.0
    if not n or events in (0, n):
        return df.sparkSession.createDataFrame([], schema)
    scaled = [((F.col(f"__r{k}") - head[f"m{k}"]) / (head[f"s{k}"] or 1.0) if c != "__one" else F.lit(1.0)).alias(f"__x{k}") for k, c in enumerate(x)]
    d = use.select("__y", "__w", *(["__g"] if fixed_effects else []), *[f"__c{k}" for k in range(len(groups))], *scaled)
    names = [f"__x{k}" for k in range(len(x))]
    penalty = np.array([0.0 if c == "__one" else ridge for c in x])
    solve = _with_levels if fixed_effects else _without_levels
    b, cov, free, converged, levels = solve(d, names, penalty, iterations, tolerance)

    def meat(keys: list[str]) -> np.ndarray:
        per = free.groupBy(*keys).agg(*[F.sum(F.col(c) * F.col("__e")).alias(c) for c in names])
        row = per.agg(F.count("*").alias("many"), *_cross(names, "q", F.lit(1.0))).first()
        many = row["many"]
        return _matrix(row, names, "q") * (many / max(many - 1, 1)) * ((n - 1) / max(n - len(x) - levels, 1))

    if groups:
        middle = meat(["__c0"])
        if len(groups) > 1:
            middle = middle + meat(["__c1"]) - meat(["__c0", "__c1"])
        cov = cov @ middle @ cov
    rows = []
    for j, name in enumerate(x):
        if name != "__one":
            se = math.sqrt(cov[j, j]) if cov[j, j] > 0 else math.nan
            rows.append((name, math.exp(b[j]), math.exp(b[j] - 1.959964 * se), math.exp(b[j] + 1.959964 * se), K.normal_p(b[j] / se) if se and se == se else math.nan, int(n), int(events), converged))
    return df.sparkSession.createDataFrame(rows, schema)


#: What the functions below return: coefficients, inverse information, rows with features (freed of the
#: effects) and residual ``__e``, whether the steps came to rest, and the number of levels.
_Fit = tuple[np.ndarray, np.ndarray, DataFrame, bool, int]


def _residuals(d: DataFrame, eta: Column) -> DataFrame:
    d = d.withColumn("__p", 1 / (1 + F.exp(-F.greatest(F.least(eta, F.lit(500.0)), F.lit(-500.0)))))
    return d.withColumns({"__h": F.col("__w") * F.col("__p") * (1 - F.col("__p")), "__e": F.col("__w") * (F.col("__y") - F.col("__p"))})


def _without_levels(d: DataFrame, names: list[str], penalty: np.ndarray, iterations: int, tolerance: float) -> _Fit:
    """Newton's method with one aggregate a step."""
    b, converged = np.zeros(len(names)), False
    while True:
        rows = _residuals(d, sum((F.col(c) * float(v) for c, v in zip(names, b)), F.lit(0.0)))
        row = rows.agg(*[F.sum(F.col("__e") * F.col(c)).alias(f"g{k}") for k, c in enumerate(names)], *_cross(names, "q", F.col("__h"))).first()
        inverse = np.linalg.pinv(_matrix(row, names, "q") + np.diag(penalty))
        if converged or iterations == 0:
            return b, inverse, rows, converged, 0
        move = inverse @ (np.array([row[f"g{k}"] for k in range(len(names))]) - penalty * b)
        move = move * min(1.0, 3.0 / max(np.abs(move).max(), 1e-12))
        b, iterations, converged = b + move, iterations - 1, bool(np.abs(move).max() < tolerance)


def _with_levels(d: DataFrame, names: list[str], penalty: np.ndarray, iterations: int, tolerance: float) -> _Fit:
    """The same with an effect for each ``__g``, eliminated in every step."""
    levels = durable(d.groupBy("__g").agg(F.avg("__y").alias("__rate")).filter("__rate > 0 and __rate < 1").select("__g", F.ln(F.col("__rate") / (1 - F.col("__rate"))).alias("__a")))
    total, k_all = levels.count(), range(len(names))
    hinted = F.broadcast if small_side(levels) is not levels else lambda side: side
    b, converged = np.zeros(len(names)), False
    inv = F.when(F.col("__d") > 1e-300, 1 / F.col("__d"))

    def fitted(side: DataFrame, b: np.ndarray) -> DataFrame:
        """Rows with their probability and information; levels without variation drop out."""
        return _residuals(d.join(hinted(side.withColumnRenamed("__g", "__l")), F.col("__g") == F.col("__l")), sum((F.col(c) * float(v) for c, v in zip(names, b)), F.col("__a")))

    def by_level(levels: DataFrame, b: np.ndarray) -> DataFrame:
        sums = fitted(levels, b).groupBy("__g").agg(
            F.first("__a").alias("__a"), F.first("__m").alias("__m"), F.sum("__h").alias("__d"), F.sum("__e").alias("__s"),
            *[F.sum(F.col("__h") * F.col(c)).alias(f"__c{k}") for k, c in enumerate(names)], *[F.sum(F.col("__e") * F.col(c)).alias(f"__s{k}") for k, c in enumerate(names)],
            *_cross(names, "__h", F.col("__h")),
        )
        return durable(sums)

    step = math.inf
    sums = by_level(levels.withColumn("__m", F.lit(0.0)), b)
    while True:
        row = sums.agg(
            F.max("__m").alias("m"), *[F.sum(F.col(f"__s{k}") - F.coalesce(F.col(f"__c{k}") * F.col("__s") * inv, F.lit(0.0))).alias(f"g{k}") for k in k_all],
            *[F.sum(F.col(f"__h{i}_{j}") - F.coalesce(F.col(f"__c{i}") * F.col(f"__c{j}") * inv, F.lit(0.0))).alias(f"q{i}_{j}") for i in k_all for j in k_all if i <= j],
        ).first()
        inverse = np.linalg.pinv(_matrix(row, names, "q") + np.diag(penalty))
        converged = max(step, row["m"] or 0.0) < tolerance
        if converged or iterations == 0:
            break
        move = inverse @ (np.array([row[f"g{k}"] or 0.0 for k in k_all]) - penalty * b)
        move = move * min(1.0, 3.0 / max(np.abs(move).max(), 1e-12))
        shift = (F.col("__s") - sum((F.col(f"__c{k}") * float(v) for k, v in enumerate(move)), F.lit(0.0))) * inv
        shift = F.coalesce(F.greatest(F.least(shift, F.lit(3.0)), F.lit(-3.0)), F.lit(0.0))
        b, step, iterations = b + move, float(np.abs(move).max()), iterations - 1
        sums = by_level(sums.select("__g", (F.col("__a") + shift).alias("__a"), F.abs(shift).alias("__m")), b)
    side = sums.select("__g", "__a", *[F.coalesce(F.col(f"__c{k}") * inv, F.lit(0.0)).alias(f"__u{k}") for k in k_all])
    free = fitted(side, b).withColumns({c: F.col(c) - F.col(f"__u{k}") for k, c in enumerate(names)})
    return b, inverse, free, converged, total


def _by_group(values: dict[str, list[float]], group: str) -> Column:
    """The list of numbers of the row's group."""
    return F.create_map(*[F.lit(v) for g, numbers in values.items() for v in (g, F.array(*[F.lit(float(n)) for n in numbers]))])[F.col(group)]


def pooled_fits(df: DataFrame, group: str, y: str, x: list[str], firth: bool = False, fixed: int | None = None, least_rows: int = 10, least_events: int = 2, iterations: int = 60, tolerance: float = 1e-8) -> dict[str, dict]:
    """One logit per value of ``group`` on all its rows, all fitted together: n, events, mean, sd, b, cov, ll, converged.

    A step is one aggregate over the rows (two with ``firth``) that sums by group with map-side
    combining, so a group may hold any number of rows; groups are specifications and periods, a
    handful. Features are per deviation of the group; ``b`` begins with the constant. ``firth``
    penalises by Jeffreys' prior (``ll`` is the penalised likelihood then), ``fixed`` holds feature
    number ``fixed`` (from 1) at zero under the full penalty. Rows with a NULL are left out; groups
    with fewer rows, events or non-events than asked have no fit.
    """
    names = ["__one", *[f"__x{k}" for k in range(len(x))]]
    use = durable(df.select(F.col(group).alias("__g"), F.col(y).cast("double").alias("__y"), *[F.col(c).cast("double").alias(n) for c, n in zip(x, names[1:])]).na.drop())
    head = use.groupBy("__g").agg(F.count("*").alias("n"), F.sum("__y").alias("events"), *[F.avg(c).alias(f"m{c}") for c in names[1:]], *[F.stddev_pop(c).alias(f"s{c}") for c in names[1:]]).collect()
    fits = {r["__g"]: {"n": r["n"], "events": int(r["events"]), "mean": [r[f"m{c}"] for c in names[1:]], "sd": [r[f"s{c}"] or 1.0 for c in names[1:]], "b": np.zeros(len(names)), "converged": False} for r in head if r["n"] >= least_rows and least_events <= r["events"] <= r["n"] - least_events}
    if not fits:
        return {}
    moments = {"m": _by_group({g: f["mean"] for g, f in fits.items()}, "__g"), "s": _by_group({g: f["sd"] for g, f in fits.items()}, "__g")}
    d = pin(use.filter(F.col("__g").isin(list(fits))), {"__m": moments["m"], "__s": moments["s"]})
    d = d.select("__g", "__y", F.lit(1.0).alias("__w"), F.lit(1.0).alias("__one"), *[((F.col(c) - F.col("__m")[k]) / F.col("__s")[k]).alias(c) for k, c in enumerate(names[1:])])
    free = np.array([j for j in range(len(names)) if j != fixed])

    def sums(extra: list[Column], more: dict[str, Column]) -> dict[str, dict]:
        rows = pin(d, {"__b": _by_group({g: list(f["b"]) for g, f in fits.items()}, "__g")})
        eta = sum((F.col(c) * F.col("__b")[j] for j, c in enumerate(names)), F.lit(0.0))
        rows = _residuals(rows, eta).withColumns({"__ll": F.ln(F.when(F.col("__y") > 0, F.col("__p")).otherwise(1 - F.col("__p"))), **more})
        return {r["__g"]: r for r in rows.groupBy("__g").agg(*extra).collect()}

    def state() -> dict[str, dict]:
        return sums([F.sum("__ll").alias("ll"), *[F.sum(F.col("__e") * F.col(c)).alias(f"g{k}") for k, c in enumerate(names)], *_cross(names, "q", F.col("__h"))], {})

    for _ in range(iterations + 1):
        rows = state()
        info = {g: _matrix(r, names, "q") for g, r in rows.items()}
        score = {g: np.array([r[f"g{k}"] for k in range(len(names))]) for g, r in rows.items()}
        if firth:
            inverse = {g: list(np.linalg.pinv(m).ravel()) for g, m in info.items()}
            leverage = F.col("__h") * sum((F.col(a) * F.col(c) * F.col("__i")[i * len(names) + j] for i, a in enumerate(names) for j, c in enumerate(names)), F.lit(0.0))
            pull = sums([F.sum(F.col("__v") * F.col(c)).alias(f"g{k}") for k, c in enumerate(names)], {"__i": _by_group(inverse, "__g"), "__v": leverage * (0.5 - F.col("__p"))})
            score = {g: v + np.array([pull[g][f"g{k}"] for k in range(len(names))]) for g, v in score.items()}
        for g, f in fits.items():
            f["cov"], f["ll"] = np.linalg.pinv(info[g]), float(rows[g]["ll"] + (0.5 * np.linalg.slogdet(info[g])[1] if firth else 0.0))
        if all(f["converged"] for f in fits.values()):
            break
        for g, f in fits.items():
            move = np.zeros(len(names))
            move[free] = np.linalg.pinv(info[g][np.ix_(free, free)]) @ score[g][free]
            move = move * min(1.0, 3.0 / max(np.abs(move).max(), 1e-12))
            f["b"], f["converged"] = f["b"] + move, bool(np.abs(move).max() < tolerance)
    return fits


def predicted(df: DataFrame, group: str, x: list[str], fits: dict[str, dict]) -> DataFrame:
    """Rows of fitted groups with ``p``, their probability under the group's fit."""
    if not fits:
        return df.limit(0).withColumn("p", F.lit(None).cast("double"))
    parts = {g: [*f["b"], *f["mean"], *f["sd"]] for g, f in fits.items()}
    k = len(x)
    d = pin(df.filter(F.col(group).isin(list(fits))), {"__f": _by_group(parts, group)})
    eta = sum((F.col("__f")[1 + j] * (F.col(c) - F.col("__f")[1 + k + j]) / F.col("__f")[1 + 2 * k + j] for j, c in enumerate(x)), F.col("__f")[0])
    return d.withColumn("p", 1 / (1 + F.exp(-eta))).drop("__f")


def pooled_report(df: DataFrame, group: str, y: str, x: list[str], **options) -> DataFrame:
    """``pooled_fits`` as a table: group, feature (x1, x2 ..), n, events, odds_ratio, z, auc, mcfadden, converged."""
    fits = pooled_fits(df, group, y, x, **options)
    schema = f"{group} string, feature string, n bigint, events bigint, odds_ratio double, z double, mcfadden double, converged boolean"
    rows = []
    for g, f in fits.items():
        rate = f["events"] / f["n"]
        null = f["n"] * (rate * math.log(rate) + (1 - rate) * math.log(1 - rate))
        for j in range(1, len(x) + 1):
            se = math.sqrt(f["cov"][j, j]) if f["cov"][j, j] > 0 else math.nan
            rows.append((g, f"x{j}", f["n"], f["events"], math.exp(min(f["b"][j], 700)), float(f["b"][j] / se), 1 - f["ll"] / null, f["converged"]))
    table = df.sparkSession.createDataFrame(rows, schema)
    scored = metrics(predicted(df.select(group, F.col(y).cast("int").alias("y"), *x).na.drop(), group, x, fits), [group]).select(group, "auc")
    return table.join(scored, group)


def grouped_quantiles(df: DataFrame, keys: list[str], y: str, x: list[str], taus: tuple[float, ...] = (0.05, 0.10, 0.25, 0.50), least_rows: int = 30) -> DataFrame:
    """Quantile regression per key and tau: coefficient per deviation of each feature and its p."""
    kinds = dict(df.dtypes)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(pdf) >= least_rows:
            design = K.with_constant(K.zscore(pdf[x].to_numpy(dtype=float)))
            for tau in taus:
                b, se = K.quantile_regression(design, pdf[y].to_numpy(dtype=float), tau)
                rows += [[*[pdf[k].iloc[0] for k in keys], tau, name, b[j], K.normal_p(b[j] / se[j]) if se[j] > 0 else math.nan, len(pdf)] for j, name in enumerate(x, start=1)]
        return pd.DataFrame(rows, columns=[*keys, "tau", "feature", "coefficient", "p", "n"])

    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "tau double", "feature string", "coefficient double", "p double", "n bigint"])
    return df.select(*keys, y, *x).na.drop().groupBy(*keys).applyInPandas(fit, schema)


def evt_labels(df: DataFrame, keys: list[str], day: str, x: str, threshold: float = 0.85, tail: float = 0.05, least: int = 5) -> DataFrame:
    """Labels -1/0/1 of values whose fitted tail probability is below ``tail``: generalised Pareto fits beyond the outer quantiles."""
    kinds = dict(df.dtypes)

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf[x].to_numpy(dtype=float)
        out = np.zeros(len(v), dtype=np.int32)
        for sign in (1, -1):
            s = sign * v
            u = np.quantile(s, threshold)
            over = s > u
            if over.sum() >= least:
                shape, scale = K.fit_gpd(s[over] - u)
                out[over & (over.mean() * K.gpd_tail(s - u, shape, scale) < tail)] = sign
        return pdf.assign(tail_label=out)[[*keys, day, x, "tail_label"]]

    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], f"{day} {kinds[day]}", f"{x} double", "tail_label int"])
    return df.select(*keys, day, F.col(x).cast("double").alias(x)).na.drop().groupBy(*keys).applyInPandas(label, schema)


def boosted_against_logit(df: DataFrame, keys: list[str], order: str, y: str, x: list[str], split: float = 0.7, least_rows: int = 60, rounds: int = 300) -> DataFrame:
    """Out-of-sample AUC of boosted trees and of a logit per key, on the last part of the rows in time order."""
    kinds = dict(df.dtypes)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        cut = int(len(pdf) * split)
        a, b = pdf.iloc[:cut], pdf.iloc[cut:]
        ya, yb = a[y].to_numpy(dtype=float), b[y].to_numpy(dtype=float)
        if len(pdf) < least_rows or min(ya.sum(), len(ya) - ya.sum()) < 2:
            return pd.DataFrame(columns=[*keys, "n", "auc_trees", "auc_logit"])
        xa, xb = a[x].to_numpy(dtype=float), b[x].to_numpy(dtype=float)
        mean, sd = xa.mean(axis=0), xa.std(axis=0)
        trees = K.predict_trees(K.grow_trees(xa, ya, rounds=rounds), xb)
        beta = K.fit_logit(K.with_constant(K.zscore(xa, mean, sd)), ya, ridge=1e-6)[0]
        return pd.DataFrame([[*[pdf[k].iloc[0] for k in keys], len(pdf), K.auc(yb, trees), K.auc(yb, K.with_constant(K.zscore(xb, mean, sd)) @ beta)]], columns=[*keys, "n", "auc_trees", "auc_logit"])

    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "n bigint", "auc_trees double", "auc_logit double"])
    return df.select(*keys, order, y, *x).na.drop().groupBy(*keys).applyInPandas(compare, schema)
