"""Walk-forward backtests, permutation tests and power simulation, parallel over steps and replicates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.operators import kernels as K


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Groups of ``keys`` over all shuffle partitions: small in bytes but long to fit, they must not be coalesced by size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def walk_forward(df: DataFrame, key: str, week: str, specs: dict[str, list[str]], half_lives: tuple[float, ...] = (104.0,), min_train: int = 60, min_events: int = 4, tail: float = 0.10, embargo: int = 4, block: int = 52, balanced: bool = False, known: str | None = None) -> DataFrame:
    """One-step-ahead predictions: ``key``, ``spec``, ``half_life``, ``week``, ``y``, ``p``, ``n_train``, ``n_train_events``.

    ``df`` holds ``ret_1w``, ``ret_1w_fwd``, ``scar`` and the features of all specs. Step k trains on
    the rows before it whose outcome is known by then: all but the last ``embargo - 1`` of them
    (``embargo=0`` keeps all), or with ``known``, a column of the day on which a row's outcome is
    settled, those settled by week k (NULL: never), however many rows or days lie between. The tail
    threshold, the moments and the weights 0.5^(age / half life) come from the training rows alone.
    All specs use the same rows, those without any NULL in features, returns or scar.

    Steps are cut into blocks; a group is one (key, block), gets the key's rows up to the block's end
    once, and fits all specs and half-lives, each half-life from where the one before ended. One key's
    series is a few thousand weeks at most.
    """
    features = sorted({c for cols in specs.values() for c in cols})
    kinds = dict(df.dtypes)
    seen = [F.col(known).cast("date").alias("__known")] if known else []
    need = [key, week, "ret_1w", "ret_1w_fwd", "scar", *features]
    use = df.select(key, week, "ret_1w", "ret_1w_fwd", F.col("scar").cast("int").alias("scar"), *features, *seen).na.drop(subset=need)
    order = F.row_number().over(Window.partitionBy(key).orderBy(week)) - 1
    total = F.count("*").over(Window.partitionBy(key))
    use = use.withColumns({"__k": order, "__n": total}).filter(F.col("__n") > min_train)
    last_block = F.floor((F.col("__n") - 1) / block)
    use = use.withColumn("__block", F.explode(F.sequence(F.floor(F.greatest(F.col("__k"), F.lit(min_train)) / block), last_block)))
    names = [key, "spec", "half_life", week, "y", "p", "n_train", "n_train_events"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__k")
        b = int(pdf["__block"].iloc[0])
        columns = {spec: pdf[cols].to_numpy(dtype=float) for spec, cols in specs.items()}
        r, fwd, scar = pdf["ret_1w"].to_numpy(), pdf["ret_1w_fwd"].to_numpy(), pdf["scar"].to_numpy() > 0
        when = pd.to_datetime(pdf[week]).to_numpy()
        settled = pd.to_datetime(pdf["__known"]).to_numpy() if known else None
        rows = []
        for k in range(max(min_train, b * block), min(len(pdf), (b + 1) * block)):
            use = np.nonzero(settled[:k] <= when[k])[0] if known else np.arange(max(0, k - max(embargo - 1, 0)))
            n = len(use)
            if n < 2:
                continue
            lo = np.quantile(r[use], tail)
            y = ((fwd[use] <= lo) & scar[use]).astype(float)
            if y.sum() < min_events or y.sum() == n:
                continue
            age = (when[k] - when[use]) / np.timedelta64(7, "D")
            even = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum()))) if balanced else 1.0
            for spec, x in columns.items():
                mean, sd = x[use].mean(axis=0), x[use].std(axis=0)
                design, at = K.with_constant(K.zscore(x[use], mean, sd)), K.with_constant(K.zscore(x[k : k + 1], mean, sd))
                beta = None
                for hl in half_lives:
                    beta = K.fit_logit(design, y, 0.5 ** (age / hl) * even, ridge=1.0, start=beta)[0]
                    rows.append([pdf[key].iloc[0], spec, hl, pdf[week].iloc[k], int(fwd[k] <= lo and scar[k]), float(K.sigmoid(at @ beta)[0]), n, int(y.sum())])
        return pd.DataFrame(rows, columns=names)

    schema = f"{key} {kinds[key]}, spec string, half_life double, {week} {kinds[week]}, y int, p double, n_train int, n_train_events int"
    return spread(use, key, "__block").groupBy(key, "__block").applyInPandas(run, schema)


def in_sample(df: DataFrame, key: str, week: str, specs: dict[str, list[str]], tail: float = 0.10) -> DataFrame:
    """Scores of the walk-forward model on its own rows: ``key``, ``spec``, ``week``, ``y``, ``p``.

    Per key and spec one L2 logit on all rows without any NULL in a feature of any spec; the tail
    threshold and the moments are of the whole sample. This looks ahead: it measures optimism only.
    """
    features = sorted({c for cols in specs.values() for c in cols})
    kinds = dict(df.dtypes)
    use = df.select(key, week, "ret_1w", "ret_1w_fwd", F.col("scar").cast("int").alias("scar"), *features).na.drop()
    names = [key, "spec", week, "y", "p"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(week)
        y = ((pdf["ret_1w_fwd"] <= np.quantile(pdf["ret_1w"], tail)) & (pdf["scar"] > 0)).to_numpy(dtype=float)
        if y.sum() in (0, len(y)):
            return pd.DataFrame(columns=names)
        parts = []
        for spec, cols in specs.items():
            x = K.with_constant(K.zscore(pdf[cols].to_numpy(dtype=float)))
            p = K.sigmoid(x @ K.fit_logit(x, y, ridge=1.0)[0])
            parts.append(pdf[[key, week]].assign(spec=spec, y=y.astype(int), p=p)[names])
        return pd.concat(parts)

    return use.groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, spec string, {week} {kinds[week]}, y int, p double")


def permutation_p(df: DataFrame, keys: list[str], order: str, y: str, x: list[str], replicates: int = 200, block: int = 1, seed: int = 3, firth: bool = True) -> DataFrame:
    """Permutation p of the first feature's coefficient per key, (c + 1) / (B + 1).

    Labels are shuffled, or with ``block`` > 1 whole runs of that many rows in ``order``. Every
    replicate has its own seed from the key and its number; replicates are spread over tasks.
    """
    kinds = dict(df.dtypes)
    per_task = 25
    d = df.select(*keys, order, y, *x).na.drop().withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // per_task) - 1))))
    fit = (lambda a, t: K.fit_firth(a, t, iterations=200, tolerance=1e-8)[0][1]) if firth else (lambda a, t: K.fit_logit(a, t, ridge=1e-6)[0][1])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        chunk = int(pdf["__chunk"].iloc[0])
        t = pdf[y].to_numpy(dtype=float)
        if len(pdf) < 10 or not 2 <= t.sum() <= len(t) - 2:
            return pd.DataFrame(columns=[*keys, "beyond", "done", "coefficient"])
        a = K.with_constant(K.zscore(pdf[x].to_numpy(dtype=float)))
        real = fit(a, t)
        starts = np.arange(0, len(t), block)
        beyond, done = 0, 0
        for b in range(chunk * per_task, min(replicates, (chunk + 1) * per_task)):
            rng = np.random.default_rng([seed, b])
            shuffled = np.concatenate([t[s : s + block] for s in rng.permutation(starts)])
            beyond += abs(fit(a, shuffled)) >= abs(real) - 1e-12
            done += 1
        return pd.DataFrame([[*[pdf[k].iloc[0] for k in keys], beyond, done, real]], columns=[*keys, "beyond", "done", "coefficient"])

    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "beyond bigint", "done bigint", "coefficient double"])
    made = spread(d, *keys, "__chunk").groupBy(*keys, "__chunk").applyInPandas(run, schema)
    return made.groupBy(*keys).agg(F.first("coefficient").alias("coefficient"), ((F.sum("beyond") + 1) / (F.sum("done") + 1)).alias("p"), F.sum("done").alias("replicates"))


def spearman_permutation(df: DataFrame, keys: list[str], x: str, y: str, replicates: int = 2000, seed: int = 5) -> DataFrame:
    """Spearman's rho per key and its permutation p; keys of four rows at least, and of some spread.

    Every replicate has its own seed, so results do not depend on how replicates are spread over tasks.
    """
    kinds = dict(df.dtypes)
    per_task = 1000
    names = [*keys, "n", "rho", "beyond", "done"]
    d = df.select(*keys, x, y).na.drop().withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // per_task) - 1))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([x, y])
        a, b = pdf[x].to_numpy(dtype=float), pdf[y].to_numpy(dtype=float)
        rho = K.spearman(a, b) if len(a) >= 4 else math.nan
        if not math.isfinite(rho):
            return pd.DataFrame(columns=names)
        ra, rb = K.ranks(a), K.ranks(b)
        ra, rb = (ra - ra.mean()) / ra.std(), (rb - rb.mean()) / rb.std()
        first = int(pdf["__chunk"].iloc[0]) * per_task
        numbers = range(first, min(replicates, first + per_task))
        hits = sum(abs((ra * np.random.default_rng([seed, k]).permutation(rb)).mean()) >= abs(rho) - 1e-12 for k in numbers)
        return pd.DataFrame([[*[pdf[k].iloc[0] for k in keys], len(a), rho, hits, len(numbers)]], columns=names)

    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "n bigint", "rho double", "beyond bigint", "done bigint"])
    made = spread(d, *keys, "__chunk").groupBy(*keys, "__chunk").applyInPandas(run, schema)
    return made.groupBy(*keys).agg(F.first("n").alias("n"), F.first("rho").alias("rho"), ((F.sum("beyond") + 1) / (F.sum("done") + 1)).alias("p"))


def calibrated_intercept(rate: float, slope: float, points: int = 2001) -> float:
    """Intercept at which a logit with a standard normal feature has the marginal event rate."""
    x = np.linspace(-6, 6, points)
    w = np.exp(-x * x / 2)
    w /= w.sum()
    lo, hi = -12.0, 12.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (w * K.sigmoid(mid + slope * x)).sum() < rate else (lo, mid)
    return (lo + hi) / 2


def simulated_power(spark: SparkSession, cells: list[tuple[int, float, float]], reps: int = 200, alpha: float = 0.05, seed: int = 11) -> DataFrame:
    """Rejection rate of the Wald test for each (n, event rate, odds ratio); degenerate draws are left out.

    Every replicate is a row with its own seed; they spread over the cluster and meet in an average.
    """
    table = pd.DataFrame(cells, columns=["n", "rate", "odds_ratio"])
    start = [calibrated_intercept(r, math.log(o)) for _, r, o in cells]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i in pdf["id"]:
                c, rep = divmod(int(i), reps)
                n, o = int(table["n"][c]), float(table["odds_ratio"][c])
                rng = np.random.default_rng([seed, c, rep])
                x = rng.standard_normal(n)
                y = (rng.random(n) < K.sigmoid(start[c] + math.log(o) * x)).astype(float)
                hit = None
                if 2 <= y.sum() <= n - 2:
                    b, cov, _ = K.fit_logit(K.with_constant(x[:, None]), y)
                    hit = float(K.normal_p(b[1] / math.sqrt(cov[1, 1])) < alpha) if cov[1, 1] > 0 else None
                out.append((c, n, float(table["rate"][c]), o, hit))
            yield pd.DataFrame(out, columns=["cell", "n", "rate", "odds_ratio", "hit"])

    tasks = max(1, min(len(cells) * reps // 50, 2000))
    rows = spark.range(0, len(cells) * reps, numPartitions=tasks).mapInPandas(run, "cell int, n int, rate double, odds_ratio double, hit double")
    return rows.groupBy("n", "rate", "odds_ratio").agg(F.avg("hit").alias("power"), F.count("hit").alias("reps"))


def required_n(power: DataFrame, target: float = 0.8) -> DataFrame:
    """Smallest n of the grid that reaches the power, by odds ratio; and the smallest odds ratio by n is its transpose."""
    return power.groupBy("rate", "odds_ratio").agg(F.min(F.when(F.col("power") >= target, F.col("n"))).alias("required_n"))


def bisected_n(spark: SparkSession, rate: float, odds_ratios: list[float], lo: int = 50, hi: int = 20_000, reps: int = 600, target: float = 0.8, steps: int = 12, **options) -> list[tuple[float, int | None]]:
    """Smallest n between ``lo`` and ``hi`` that reaches the power, by odds ratio; None where ``hi`` does not.

    Bisection on the simulated power; a step is one job over all odds ratios that are still open.
    """

    def reaches(sizes: dict[float, int]) -> dict[float, bool]:
        rows = simulated_power(spark, [(n, rate, o) for o, n in sizes.items()], reps, **options).collect()
        return {r["odds_ratio"]: r["power"] is not None and r["power"] >= target for r in rows}

    ends = reaches({o: hi for o in odds_ratios})
    bounds = {o: (lo, hi) for o in odds_ratios if ends[o]}
    for _ in range(steps):
        middle = {o: (a + b) // 2 for o, (a, b) in bounds.items() if b - a > 1}
        if not middle:
            break
        for o, enough in reaches(middle).items():
            bounds[o] = (bounds[o][0], middle[o]) if enough else (middle[o], bounds[o][1])
    return [(o, bounds[o][1] if o in bounds else None) for o in odds_ratios]


def smallest_detectable(spark: SparkSession, rate: float, sizes: list[int], grid: list[float], reps: int = 600, target: float = 0.8, at_once: int = 10, **options) -> list[tuple[int, float | None]]:
    """Smallest odds ratio of the whole ``grid`` that reaches the power, by n; None where none does.

    Searched upward, ``at_once`` odds ratios a job, and for each n only as far as the first that does.
    """
    found: dict[int, float | None] = dict.fromkeys(sizes)
    for k in range(0, len(grid), at_once):
        cells = [(n, rate, o) for n in sizes if found[n] is None for o in grid[k : k + at_once]]
        if not cells:
            break
        found |= {r["n"]: r["detectable_or"] for r in detectable(simulated_power(spark, cells, reps, **options), target).collect()}
    return list(found.items())


def detectable(power: DataFrame, target: float = 0.8) -> DataFrame:
    """Smallest odds ratio of the grid that reaches the power, by n."""
    return power.groupBy("rate", "n").agg(F.min(F.when(F.col("power") >= target, F.col("odds_ratio"))).alias("detectable_or"))
