"""Operators whose leaf is linear algebra or iteration: one Arrow-backed group function each.

A group is one family of patients or folds, a size that the study design of patient data
bounds; the number of groups is what grows, and groups run in parallel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import numeric, special


def _schema(df: DataFrame, by: list[str], rest: str) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by) + ", " + rest


def _apply(df: DataFrame, by: list[str], columns: list[str], rest: str, solve) -> DataFrame:
    """``solve`` maps a group's frame (columns only) to a dict or a list of dicts of the ``rest`` columns."""
    names = [part.split()[0] for part in rest.split(", ")]

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        found = solve(frame)
        rows = pd.DataFrame(found if isinstance(found, list) else [found], columns=names)
        for column, value in reversed(list(zip(by, key))):
            rows.insert(0, column, value)
        return rows

    used = list(dict.fromkeys([*by, *columns]))
    # Groups are small and costly: a set number of partitions keeps them apart, where sizes alone would join them in one task.
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.select(*used).repartition(parts, *by).groupBy(*by).applyInPandas(run, _schema(df, by, rest))


def regression(df: DataFrame, by: list[str], y: str, exposure: str, covariates: list[str] = (), cluster: str | None = None, min_df: int = 10, z_score: bool = False) -> DataFrame:
    """Effect of ``exposure`` with HC3, or cluster-robust, errors; gates on arms, rank and residual df."""
    rest = "status string, n long, effect double, se double, t double, p double, df double"

    def solve(frame: pd.DataFrame) -> dict:
        used = frame.dropna().sort_values(list(frame.columns), kind="stable")
        e = used[exposure].to_numpy(float)
        out = {"status": "insufficient", "n": len(used)}
        if len(np.unique(e)) == 2 and min((e == e.min()).sum(), (e == e.max()).sum()) < 5:
            return out
        parts = [e]
        for c in covariates:
            v = used[c].to_numpy(float)
            if len(v) and np.ptp(v) > 0:
                parts.append((v - v.mean()) / v.std(ddof=1) if z_score else v - v.mean())
        x = np.column_stack([np.ones(len(used)), *parts])
        if len(used) - x.shape[1] < min_df:
            return out | {"status": "residual_df"}
        fit = numeric.ols(x, used[y].to_numpy(float), used[cluster].to_numpy() if cluster else None)
        if fit["status"] != "estimated":
            return out | {"status": fit["status"]}
        return {"status": "estimated", "n": len(used), "effect": fit["beta"][1], "se": fit["se"][1], "t": fit["t"][1], "p": fit["p"][1], "df": float(fit["df"])}

    return _apply(df, by, [y, exposure, *covariates, *([cluster] if cluster else [])], rest, solve)


def reml(effects: DataFrame, by: list[str], effect: str, se: str, min_k: int = 3) -> DataFrame:
    """REML random-effects pooling with modified Hartung-Knapp; rows below ``min_k`` studies are kept."""
    names = "k effect se ci_low ci_high p tau2 q i2 hk_scale".split()
    rest = "status string, k long, " + ", ".join(f"{n} double" for n in names[1:])

    def solve(frame: pd.DataFrame) -> dict:
        used = frame.dropna()
        used = used[used[se] > 0].sort_values([effect, se], kind="stable")
        if len(used) < min_k:
            return {"status": "insufficient_cohorts", "k": len(used)}
        return {"status": "estimated"} | numeric.meta_reml(used[effect].to_numpy(), used[se].to_numpy() ** 2)

    return _apply(effects, by, [effect, se], rest, solve)


def rank_correlation(df: DataFrame, by: list[str], x: str, y: str, covariates: list[str] = (), min_n: int = 3) -> DataFrame:
    """Spearman's rho, or the partial one given covariates, on complete cases."""

    def solve(frame: pd.DataFrame) -> dict:
        used = frame.dropna()
        a, b = used[x].to_numpy(float), used[y].to_numpy(float)
        if len(used) < min_n:
            return {"n": len(used), "rho": np.nan, "p": np.nan, "df": np.nan}
        if not covariates:
            rho, p = numeric.spearman(a, b)
            return {"n": len(used), "rho": rho, "p": p, "df": float(len(used) - 2)}
        rho, p, dof = numeric.partial_spearman(a, b, used[list(covariates)].to_numpy(float))
        return {"n": len(used), "rho": rho, "p": p, "df": float(dof)}

    return _apply(df, by, [x, y, *covariates], "n long, rho double, p double, df double", solve)


def paired_summary(deltas: DataFrame, by: list[str], unit: str, value: str, draws: int = 2000, seed: int = 1, half_ties: bool = True) -> DataFrame:
    """Paired t, Wilcoxon and a BCa interval over one shared matrix of resampled units per group."""
    rest = "n long, mean double, sd double, t_p double, wilcoxon_p double, ci_low double, ci_high double"

    def solve(frame: pd.DataFrame) -> dict:
        x = frame.dropna().sort_values(unit, kind="stable")[value].to_numpy(float)
        n = len(x)
        if n < 3:
            return {"n": n}
        sd = x.std(ddof=1)
        p = 1.0 if not x.any() else 0.0 if sd == 0 else float(special.t_two_sided(x.mean() / (sd / np.sqrt(n)), n - 1))
        sample = x[np.random.default_rng(seed).integers(0, n, (draws, n))].mean(1)
        low, high = numeric.bca_interval(x, sample, half_ties=half_ties)
        return {"n": n, "mean": x.mean(), "sd": sd, "t_p": p, "wilcoxon_p": numeric.wilcoxon_p(x), "ci_low": low, "ci_high": high}

    return _apply(deltas, by, [unit, value], rest, solve)


def principal_axis(df: DataFrame, by: list[str], unit: str, features: list[str], ddof: int = 1, sign: str = "largest") -> DataFrame:
    """Loadings of the first axis of the z-scored features over complete units."""

    def solve(frame: pd.DataFrame) -> list[dict]:
        x = frame.dropna().sort_values(unit, kind="stable")[features].to_numpy(float)
        if len(x) < 3:
            return []
        load, _, share = numeric.pc1(x, ddof, sign)
        return [{"feature": f, "loading": v, "variance_share": share, "n": len(x)} for f, v in zip(features, load)]

    return _apply(df, by, [unit, *features], "feature string, loading double, variance_share double, n long", solve)


def block_permutation(df: DataFrame, by: list[str], unit: str, groups: dict[str, list[str]], draws: int = 200, seed: int = 1, blocks: bool = True) -> DataFrame:
    """Median correlation between gene groups against permuted units, column by column or group by group."""
    features = [f for members in groups.values() for f in members]
    label = np.array([g for g, members in groups.items() for _ in members])

    def median(x: np.ndarray) -> float:
        i, j = np.triu_indices(x.shape[1], 1)
        use = label[i] != label[j]
        z = x - x.mean(0)
        z = z / np.maximum(np.sqrt((z**2).sum(0)), 1e-300)
        return float(np.median((z.T @ z)[i[use], j[use]]))

    def solve(frame: pd.DataFrame) -> dict:
        x = frame.dropna().sort_values(unit, kind="stable")[features].to_numpy(float)
        if len(x) < 5:
            return {"n": len(x)}
        x = np.column_stack([numeric.midranks(c) for c in x.T])
        rng, observed, hits = np.random.default_rng(seed), median(x), 0
        for _ in range(draws):
            y = x.copy()
            for g in dict.fromkeys(label) if blocks else range(x.shape[1]):
                columns = label == g if blocks else np.arange(x.shape[1]) == g
                y[:, columns] = x[rng.permutation(len(x))][:, columns]
            hits += median(y) >= observed - 1e-12
        return {"n": len(x), "observed": observed, "p": (1 + hits) / (draws + 1)}

    return _apply(df, by, [unit, *features], "n long, observed double, p double", solve)


CANDIDATES = (0.01, 0.1, 1.0, 10.0)


def _standard(train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the training rows only."""
    sd = train.std(0)
    return train.mean(0), np.where(sd > 0, sd, 1.0)


def _fit(x: np.ndarray, y: np.ndarray, c: float):
    mean, sd = _standard(x)
    beta = numeric.ridge_logistic((x - mean) / sd, y, c)
    return lambda z: ((z - mean) / sd) @ beta[:-1] + beta[-1]


def _one_se(x: np.ndarray, y: np.ndarray, inner: np.ndarray) -> float:
    """The strongest penalty within one standard error of the best mean inner AUC."""
    scores = np.array([[numeric.fast_auc(y[inner == f], _fit(x[inner != f], y[inner != f], c)(x[inner == f])) for f in np.unique(inner)] for c in CANDIDATES])
    mean = np.nanmean(scores, 1)
    best = int(np.nanargmax(mean))
    error = np.nanstd(scores[best], ddof=1) / np.sqrt(scores.shape[1])
    return min(c for c, m in zip(CANDIDATES, mean) if m >= mean[best] - error)


def nested_cv(rows: DataFrame, folds: DataFrame, unit: str, y: str, features: list[str], inner: int = 4) -> DataFrame:
    """Out-of-fold scores: one task per (repeat, fold) tunes on its training units, fits and predicts.

    ``folds`` has repeat, unit and fold.  Scaling and tuning see training units only.
    """
    jobs = folds.select("repeat", "fold").distinct().withColumnRenamed("fold", "held")
    data = rows.select(unit, y, *features).join(folds, unit)
    every = data.join(F.broadcast(jobs), "repeat")

    def solve(frame: pd.DataFrame) -> list[dict]:
        frame = frame.sort_values(unit, kind="stable")
        test = (frame["fold"] == frame["held"]).to_numpy()
        x, labels = frame[features].to_numpy(float), frame[y].to_numpy(int)
        parts = np.arange((~test).sum()) % inner
        c = _one_se(x[~test], labels[~test], parts)
        score = _fit(x[~test], labels[~test], c)(x[test])
        return [{unit: u, y: t, "c": c, "score": s} for u, t, s in zip(frame[unit][test], labels[test], score)]

    kind = rows.schema[unit].dataType.simpleString()
    return _apply(every, ["repeat", "held"], ["fold", unit, y, *features], f"{unit} {kind}, {y} int, c double, score double", solve)


def cox_model(counts: DataFrame, by: list[str], covariates: list[str], time: str = "t", event: str = "event", n: str = "n", ridge: float = 0.0) -> DataFrame:
    """Cox regression over counted levels: coefficient, hazard ratio and Wald p of each covariate."""

    def solve(frame: pd.DataFrame) -> list[dict]:
        frame = frame.sort_values([time, event, *covariates], kind="stable")
        fit = numeric.cox(frame[time].to_numpy(float), frame[event].to_numpy(int), frame[covariates].to_numpy(float), frame[n].to_numpy(float), ridge)
        z = fit["beta"] / fit["se"]
        return [
            {"covariate": c, "beta": b, "hazard_ratio": float(np.exp(b)), "se": s, "p": p, "n_events": int(frame[n][frame[event] == 1].sum())}
            for c, b, s, p in zip(covariates, fit["beta"], fit["se"], 2 * special.norm_sf(np.abs(z)))
        ]

    return _apply(counts, by, [time, event, n, *covariates], "covariate string, beta double, hazard_ratio double, se double, p double, n_events long", solve)


def spearman_bootstrap(df: DataFrame, by: list[str], unit: str, x: str, y: str, draws: int = 1000, seed: int = 1, level: float = 0.95) -> DataFrame:
    """Percentile interval of Spearman's rho; every resample is ranked anew."""

    def solve(frame: pd.DataFrame) -> dict:
        used = frame.dropna().sort_values(unit, kind="stable")
        a, b = used[x].to_numpy(float), used[y].to_numpy(float)
        if len(used) < 3:
            return {"n": len(used)}
        rng = np.random.default_rng(seed)
        found = np.array([numeric.spearman(a[at], b[at])[0] for at in rng.integers(0, len(a), (draws, len(a)))])
        low, high = np.nanquantile(found, [(1 - level) / 2, (1 + level) / 2]) if np.isfinite(found).any() else (np.nan, np.nan)
        return {"n": len(used), "rho": numeric.spearman(a, b)[0], "low": low, "high": high, "n_valid": int(np.isfinite(found).sum())}

    return _apply(df, by, [unit, x, y], "n long, rho double, low double, high double, n_valid double", solve)


def calibration(df: DataFrame, by: list[str], y: str, score: str, weight: str | None = None) -> DataFrame:
    """Slope and intercept of a logistic recalibration of the score, optionally with (censoring) weights."""

    def solve(frame: pd.DataFrame) -> dict:
        used = frame.dropna()
        labels, s = used[y].to_numpy(float), used[score].to_numpy(float)
        if len(np.unique(labels)) < 2 or np.ptp(s) == 0:
            return {"status": "not_estimable"}
        w = used[weight].to_numpy(float) if weight else None
        # A very large c makes the penalty vanish.
        slope, intercept = numeric.ridge_logistic(s[:, None], labels, 1e8, w)
        return {"status": "estimated", "slope": slope, "intercept": intercept}

    return _apply(df, by, [y, score, *([weight] if weight else [])], "status string, slope double, intercept double", solve)
