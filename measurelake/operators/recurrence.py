"""Survival models over counted levels: risk on a grid, penalised paths with tuning, proportionality, joint permutation.

Rows carry a count ``n``; a group is the distinct levels of (time, event,
covariates), whatever the number of subjects, so a leaf function gets a table
bounded by the levels.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import numeric, special
from .grouped import _apply
from .relational import step_lookup
from .survival import FLOOR, breslow, kaplan_meier


def brier_grid(df: DataFrame, by: list[str], linear: Column, horizon: float, points: int = 101, floor: float = FLOOR) -> DataFrame:
    """IPCW Brier score of a Cox risk (Breslow baseline, linear predictor ``linear``) at each point of an even grid from 0."""
    levels = df.groupBy(*by, "t", "event", "score").agg(F.sum("n").alias("n"))
    step = horizon / (points - 1)
    taus = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: i * F.lit(step))
    asked = levels.select(*by).distinct().select(*by, F.explode(taus).alias("tau"))
    censor = kaplan_meier(levels, by, of=0)
    hazard = breslow(levels, by, F.exp(linear)).withColumn("tau", F.col("t").cast("double"))
    found = step_lookup(hazard, asked, by, "tau", "cumhaz").select(*by, "tau", F.coalesce("cumhaz", F.lit(0.0)).alias("h"))
    kept = step_lookup(censor.withColumn("tau", F.col("t").cast("double")), asked, by, "tau", "surv")
    at = kept.select(*by, "tau", F.coalesce("surv", F.lit(1.0)).alias("g")).join(found, [*by, "tau"])
    rows = levels.join(censor.select(*by, "t", F.col("surv_before").alias("g_before")), [*by, "t"]).join(at, by)
    risk = 1 - F.exp(-F.col("h") * F.exp(linear))
    case, control = (F.col("event") == 1) & (F.col("t") <= F.col("tau")), F.col("t") > F.col("tau")
    term = F.when(case, F.col("n") * (1 - risk) * (1 - risk) / F.col("g_before")).when(control, F.col("n") * risk * risk / F.col("g")).otherwise(0.0)
    used = F.when(case, F.col("g_before")).when(control, F.col("g")).otherwise(1.0)
    out = rows.groupBy(*by, "tau").agg((F.sum(term) / F.sum("n")).alias("brier"), F.min(used).alias("least"))
    return out.select(*by, "tau", F.when(F.col("least") > floor, F.col("brier")).alias("brier"))


def integrated(grid: DataFrame, by: list[str], horizon: float) -> DataFrame:
    """Trapezoid integral of the grid's scores over the horizon; null if any point is."""
    order = Window.partitionBy(*by).orderBy("tau")
    area = (F.lead("tau").over(order) - F.col("tau")) * (F.lead("brier").over(order) + F.col("brier")) / 2
    out = grid.withColumn("__a", area).groupBy(*by).agg(F.sum("__a").alias("__s"), F.count("brier").alias("n_points"), F.count(F.lit(1)).alias("__n"))
    return out.select(*by, "n_points", F.when(F.col("n_points") == F.col("__n"), F.col("__s") / F.lit(float(horizon))).alias("ibs"))


def cox_path(counts: DataFrame, by: list[str], covariates: list[str], penalties: list[float], mix: float, time: str = "t", event: str = "event", n: str = "n") -> DataFrame:
    """Coefficients of standardised covariates along a path of penalties, strongest first (each fit starts at the last)."""

    def solve(frame: pd.DataFrame) -> list[dict]:
        frame = frame.sort_values([time, event, *covariates], kind="stable")
        x, w = frame[covariates].to_numpy(float), frame[n].to_numpy(float)
        mean, sd = numeric.weighted_scale(x, w)
        betas = numeric.cox_path(frame[time].to_numpy(float), frame[event].to_numpy(int), (x - mean) / sd, w, penalties, mix)
        return [{"penalty": p, "covariate": c, "beta": b} for p, row in zip(penalties, betas) for c, b in zip(covariates, row)]

    return _apply(counts, by, [time, event, n, *covariates], "penalty double, covariate string, beta double", solve)


def cox_tuned(counts: DataFrame, by: list[str], inner: str, covariates: list[str], penalties: list[float], mix: float, time: str = "t", event: str = "event", n: str = "n") -> DataFrame:
    """The penalty of least inner cross-validated deviance, the strongest within one standard error of it, and its fit.

    A penalty counts only if the deviance of every inner fold is finite.
    """

    def solve(frame: pd.DataFrame) -> list[dict]:
        frame = frame.sort_values([time, event, inner, *covariates], kind="stable")
        t, e, w = frame[time].to_numpy(float), frame[event].to_numpy(int), frame[n].to_numpy(float)
        x, fold = frame[covariates].to_numpy(float), frame[inner].to_numpy(int)
        losses = []
        for f in np.unique(fold):
            test = fold == f
            mean, sd = numeric.weighted_scale(x[~test], w[~test])
            betas = numeric.cox_path(t[~test], e[~test], (x[~test] - mean) / sd, w[~test], penalties, mix)
            z = (x[test] - mean) / sd
            losses.append([numeric.cox_deviance(t[test], e[test], z @ b, w[test]) for b in betas])
        best, chosen = numeric.one_se(np.array(losses), penalties)
        mean, sd = numeric.weighted_scale(x, w)
        beta = numeric.cox_path(t, e, (x - mean) / sd, w, [chosen], mix)[0]
        return [{"best_penalty": best, "penalty": chosen, "covariate": c, "beta": b, "beta_raw": b / s} for c, b, s in zip(covariates, beta, sd)]

    return _apply(counts, by, [time, event, inner, n, *covariates], "best_penalty double, penalty double, covariate string, beta double, beta_raw double", solve)


def proportionality(counts: DataFrame, by: list[str], covariate: str, time: str = "t", event: str = "event", n: str = "n") -> DataFrame:
    """Trend of the Schoenfeld residuals of a one-covariate Cox model over event time: correlation, chi-square and p."""

    def solve(frame: pd.DataFrame) -> list[dict]:
        frame = frame.sort_values([time, event, covariate], kind="stable")
        t, e, w = frame[time].to_numpy(float), frame[event].to_numpy(int), frame[n].to_numpy(float)
        x = frame[covariate].to_numpy(float)
        fit = numeric.cox(t, e, x[:, None], w)
        rho, chi2 = numeric.schoenfeld_trend(t, e, x, w, float(fit["beta"][0]), float(fit["se"][0]))
        return [{"beta": fit["beta"][0], "rho": rho, "chi2": chi2, "p": 2 * float(special.norm_sf(np.sqrt(chi2))), "n_events": int(w[e == 1].sum())}]

    return _apply(counts, by, [time, event, n, covariate], "beta double, rho double, chi2 double, p double, n_events long", solve)


#: numpy draws hypergeometric counts from populations below this size.
MOST_SUBJECTS = 10**9


def joint_permutation(counts: DataFrame, by: list[str], draws: int, seed: int, horizon: float, floor: float = FLOOR, block: int = 50) -> DataFrame:
    """Add-one p of Uno's C when (time, event) pairs are permuted together against the scores.

    A permutation of subjects is a random table of scores by (time, event) with
    both margins kept, and is drawn as that: the cost of a draw does not depend
    on the number of subjects.  Draws go to tasks in blocks; a draw's table
    depends on the seed, its number and the group alone.  p is null if any draw
    has no estimate: none is dropped.  Groups of ``MOST_SUBJECTS`` subjects or more raise.
    """
    levels = counts.groupBy(*by, "t", "event", "score").agg(F.sum("n").alias("n"))
    blocks = F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // block))).alias("__block")

    def solve(frame: pd.DataFrame) -> list[dict]:
        key = zlib.crc32("|".join(str(frame[b].iloc[0]) for b in by).encode())
        first = int(frame["__block"].iloc[0]) * block
        cells = frame.pivot_table(index="score", columns=["t", "event"], values="n", aggfunc="sum", fill_value=0).sort_index(axis=0).sort_index(axis=1)
        table = cells.to_numpy(np.int64)
        if table.sum() >= MOST_SUBJECTS:
            raise ValueError("joint_permutation draws from fewer than 10^9 subjects a group")
        t, e = (np.array(cells.columns.get_level_values(i), float) for i in (0, 1))
        out = [{"draw": -1, "value": numeric.uno_c(table, t, e, horizon, floor), "mark": ""}] if first == 0 else []
        for draw in range(first, min(first + block, draws)):
            drawn = numeric.random_table(table, np.random.default_rng([seed, key, draw]))
            out.append({"draw": draw, "value": numeric.uno_c(drawn, t, e, horizon, floor), "mark": f"{zlib.crc32(drawn.tobytes()):08x}"})
        return out

    every = levels.select("*", blocks)
    told = _apply(every, [*by, "__block"], [*by, "__block", "t", "event", "score", "n"], "draw int, value double, mark string", solve)
    observed = F.max(F.when(F.col("draw") < 0, F.col("value")))
    sums = told.groupBy(*by).agg(
        observed.alias("observed"),
        F.count_if((F.col("draw") >= 0) & F.col("value").isNotNull() & ~F.isnan("value")).alias("n_valid"),
        F.count_distinct(F.when(F.col("draw") >= 0, F.col("mark"))).alias("n_distinct"),
        F.collect_list(F.when(F.col("draw") >= 0, F.col("value"))).alias("__null"),
    )
    extreme = F.size(F.filter("__null", lambda v: v >= F.col("observed") - 1e-12))
    p = F.when((F.col("n_valid") == draws) & ~F.isnan("observed"), (extreme + 1) / F.lit(draws + 1.0))
    return sums.select(*by, "observed", F.lit(draws).cast("long").alias("n_draws"), "n_valid", "n_distinct", extreme.cast("long").alias("n_extreme"), p.alias("p"))


def metric_bootstrap(counts: DataFrame, by: list[str], scores: list[str], draws: int, seed: int, horizon: float, floor: float = FLOOR, level: float = 0.95) -> DataFrame:
    """Uno's C of each score and of each score less the first one, with percentile intervals over the same draws.

    A sample of subjects with replacement is a multinomial count of the levels:
    a draw costs the levels, not the subjects.
    """
    levels = counts.groupBy(*by, "t", "event", *scores).agg(F.sum("n").alias("n"))

    def solve(frame: pd.DataFrame) -> list[dict]:
        key = zlib.crc32("|".join(str(frame[b].iloc[0]) for b in by).encode())
        frame = frame.sort_values(["t", "event", *scores], kind="stable")
        cells, cell = np.unique(frame[["t", "event"]].to_numpy(float), axis=0, return_inverse=True)
        rank = [np.unique(frame[s].to_numpy(), return_inverse=True)[1] for s in scores]
        n = frame["n"].to_numpy(np.int64)

        def values(weight):
            out = []
            for r in rank:
                table = np.zeros((r.max() + 1, len(cells)), np.int64)
                np.add.at(table, (r, cell.ravel()), weight)
                out.append(numeric.uno_c(table, cells[:, 0], cells[:, 1], horizon, floor))
            return out + [v - out[0] for v in out[1:]]

        rng = np.random.default_rng([seed, key])
        observed = values(n)
        drawn = np.array([values(rng.multinomial(n.sum(), n / n.sum())) for _ in range(draws)])
        names = [*scores, *[f"{s}-{scores[0]}" for s in scores[1:]]]
        rows = []
        for name, value, column in zip(names, observed, drawn.T):
            used = column[np.isfinite(column)]
            low, high = np.quantile(used, [(1 - level) / 2, (1 + level) / 2]) if len(used) else (np.nan, np.nan)
            rows.append({"metric": name, "value": value, "low": low, "high": high, "n_valid": len(used)})
        return rows

    return _apply(levels, by, [*by, "t", "event", "n", *scores], "metric string, value double, low double, high double, n_valid long", solve)
