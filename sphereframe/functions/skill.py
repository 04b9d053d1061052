"""Forecast skill scores as one set of aggregate Columns.

``skill_columns`` is the reusable custom aggregate: a list of named Columns to
hand to ``groupBy(...).agg(...)``.  All scores come from the same handful of
mergeable moments, so one partial aggregation serves every one of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import col, safe_div

MAGNITUDE = ("BIAS", "MAE", "MSE", "RMSE", "relBIAS", "relMAE", "relMSE", "relRMSE",
             "percBIAS", "percMAE", "percMSE", "percRMSE")
AVERAGE = ("rMean", "diffMean")
VARIABILITY = ("rSD", "diffSD", "obs_CoV", "pred_CoV", "rCoV", "diffCoV", "error_CoV")
CORRELATION = ("pearson_R", "pearson_R2", "pearson_t", "pearson_dof")
OVERALL = ("NSE", "KGE")
ALL_SKILLS = MAGNITUDE + AVERAGE + VARIABILITY + CORRELATION + OVERALL

# Value a perfect forecast reaches, where one exists.
IDEAL = {name: 0.0 for name in MAGNITUDE + ("diffMean", "diffSD", "diffCoV", "error_CoV")}
IDEAL |= {name: 1.0 for name in ("rMean", "rSD", "rCoV", "pearson_R", "pearson_R2",
                                 "spearman_R", "spearman_R2", "NSE", "KGE")}


def moment_columns(pred: str | Column, obs: str | Column, prefix: str = "") -> list[Column]:
    """Mergeable moments of the pairs where both sides exist, named ``<prefix>n``, ``<prefix>mp``, ..."""
    both = col(pred).isNotNull() & col(obs).isNotNull()
    p = F.when(both, col(pred))
    o = F.when(both, col(obs))
    e = p - o
    moments = {"n": F.count(e), "mp": F.avg(p), "mo": F.avg(o), "me": F.avg(e), "mae": F.avg(F.abs(e)),
               "mse": F.avg(e * e), "sp": F.stddev_pop(p), "so": F.stddev_pop(o), "se": F.stddev_pop(e),
               "cov": F.covar_pop(p, o)}
    return [c.alias(prefix + name) for name, c in moments.items()]


def scores_from_moments(prefix: str = "") -> dict[str, Column]:
    """Every score as an expression over the moment columns."""
    n, mp, mo, me, mae, mse, sp, so, se, cov = (
        F.col(prefix + m) for m in ("n", "mp", "mo", "me", "mae", "mse", "sp", "so", "se", "cov"))
    rmse = F.sqrt(mse)
    out: dict[str, Column] = {"BIAS": me, "MAE": mae, "MSE": mse, "RMSE": rmse}
    for name in ("BIAS", "MAE", "MSE", "RMSE"):
        out[f"rel{name}"] = safe_div(out[name], mo)
    for name in ("BIAS", "MAE", "MSE", "RMSE"):
        out[f"perc{name}"] = F.lit(100.0) * out[f"rel{name}"]
    out["rMean"] = safe_div(mp, mo)
    out["diffMean"] = mp - mo
    out["rSD"] = safe_div(sp, so)
    out["diffSD"] = sp - so
    out["obs_CoV"] = safe_div(so, mo)
    out["pred_CoV"] = safe_div(sp, mp)
    out["rCoV"] = safe_div(out["pred_CoV"], out["obs_CoV"])
    out["diffCoV"] = out["pred_CoV"] - out["obs_CoV"]
    out["error_CoV"] = safe_div(se, me)
    r = safe_div(cov, sp * so)
    out["pearson_R"] = r
    out["pearson_R2"] = r * r
    out["pearson_t"] = F.when(n > 2, t_statistic(r, n))
    out["pearson_dof"] = F.when(n > 2, (n - 2).cast("double"))
    out["NSE"] = F.lit(1.0) - safe_div(mse, so * so)
    off = [r - 1, out["rSD"] - 1, out["rMean"] - 1]
    out["KGE"] = F.lit(1.0) - F.sqrt(off[0] * off[0] + off[1] * off[1] + off[2] * off[2])
    return out


def t_statistic(r: Column, n: Column) -> Column:
    """t value of a correlation of ``n`` pairs."""
    return r * F.sqrt(safe_div((n - 2).cast("double"), F.lit(1.0) - r * r))


def _known(skills: Iterable[str]) -> list[str]:
    wanted = list(skills)
    unknown = set(wanted) - set(ALL_SKILLS)
    if unknown:
        raise ValueError(f"unknown skills {sorted(unknown)}")
    return wanted


def skill_columns(df: DataFrame, pred: str, obs: str, by: Iterable[str],
                  skills: Iterable[str] = ALL_SKILLS) -> DataFrame:
    """Wide skill table: one row per group, one column per score plus ``n``."""
    wanted, by = _known(skills), list(by)
    scores = scores_from_moments("_m_")
    return (df.groupBy(*by).agg(*moment_columns(pred, obs, "_m_"))
            .select(*by, F.col("_m_n").alias("n"), *[scores[s].alias(s) for s in wanted]))


def skill_table(df: DataFrame, pairs: Mapping[str, tuple[str, str]], by: Iterable[str],
                skills: Iterable[str] = ALL_SKILLS) -> DataFrame:
    """Long skill table (<by>, variable, skill, value) of several variables {name: (pred, obs)} in one pass."""
    wanted, by = _known(skills), list(by)
    prefixes = {v: f"_m{i}_" for i, v in enumerate(pairs)}
    moments = [m for v, (p, o) in pairs.items() for m in moment_columns(p, o, prefixes[v])]
    entries = []
    for v, prefix in prefixes.items():
        scores = scores_from_moments(prefix)
        entries += [F.struct(F.lit(v).alias("variable"), F.lit(s).alias("skill"), scores[s].alias("value")) for s in wanted]
    return df.groupBy(*by).agg(*moments).select(*by, F.explode(F.array(*entries)).alias("_e")).select(*by, "_e.*")
