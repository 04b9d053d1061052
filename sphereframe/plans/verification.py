"""Queries over forecast verification and Hovmoller diagrams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import skill as sk
from ..operators import align, hovmoller, scalers, verify
from .registry import query
from .views import LEADS, MEMBERS, PERSISTENCE_LEADS, Tables, hours

# SQL of the same moments and scores; `n` rows per group.
SQL_MOMENTS = ("count(*) AS n, avg({p}) AS mp, avg({o}) AS mo, avg({p} - {o}) AS me, avg(abs({p} - {o})) AS mae, "
               "avg(({p} - {o}) * ({p} - {o})) AS mse, stddev_pop({p}) AS sp, stddev_pop({o}) AS so, "
               "stddev_pop({p} - {o}) AS se, covar_pop({p}, {o}) AS cov")
_R = "(cov / nullif(sp * so, 0))"
SQL_SCORES = {
    "BIAS": "me", "MAE": "mae", "MSE": "mse", "RMSE": "sqrt(mse)",
    "relBIAS": "me / nullif(mo, 0)", "relMAE": "mae / nullif(mo, 0)", "relMSE": "mse / nullif(mo, 0)",
    "relRMSE": "sqrt(mse) / nullif(mo, 0)",
    "percBIAS": "100 * me / nullif(mo, 0)", "percMAE": "100 * mae / nullif(mo, 0)",
    "percMSE": "100 * mse / nullif(mo, 0)", "percRMSE": "100 * sqrt(mse) / nullif(mo, 0)",
    "rMean": "mp / nullif(mo, 0)", "diffMean": "mp - mo",
    "rSD": "sp / nullif(so, 0)", "diffSD": "sp - so", "obs_CoV": "so / nullif(mo, 0)", "pred_CoV": "sp / nullif(mp, 0)",
    "rCoV": "(sp / nullif(mp, 0)) / nullif(so / nullif(mo, 0), 0)", "diffCoV": "sp / nullif(mp, 0) - so / nullif(mo, 0)",
    "error_CoV": "se / nullif(me, 0)",
    "pearson_R": _R, "pearson_R2": f"{_R} * {_R}",
    "pearson_t": f"CASE WHEN n > 2 THEN {_R} * sqrt((n - 2) / nullif(1 - {_R} * {_R}, 0)) END",
    "pearson_dof": "CASE WHEN n > 2 THEN CAST(n - 2 AS DOUBLE) END",
    "NSE": "1 - mse / nullif(so * so, 0)",
    "KGE": f"1 - sqrt(({_R} - 1) * ({_R} - 1) + (sp / nullif(so, 0) - 1) * (sp / nullif(so, 0) - 1) "
           "+ (mp / nullif(mo, 0) - 1) * (mp / nullif(mo, 0) - 1))",
}


def wide_sql(source: str, p: str, o: str, by: str, skills) -> str:
    """Wide skill table."""
    keys = by.split(", ")
    moments = SQL_MOMENTS.format(p=p, o=o)
    scores = ", ".join(f"{SQL_SCORES[s]} AS {s}" for s in skills)
    return f"SELECT {by}, n, {scores} FROM (SELECT {by}, {moments} FROM {source} GROUP BY {', '.join(map(str, range(1, len(keys) + 1)))})"


def long_sql(source: str, p: str, o: str, by: str, skills, variable: str = "z") -> str:
    """Long skill table."""
    wide = wide_sql(source, p, o, by, skills)
    names = ", ".join(f"'{s}'" for s in skills)
    values = ", ".join(skills)
    return (f"SELECT {by}, unnest([{names}]) AS skill, unnest([{values}]) AS value, '{variable}' AS variable FROM ({wide})")


def _family(name: str, survey_id: str, skills):
    def build(t: Tables):
        return sk.skill_columns(t.fcst_pairs, "z_pred", "z_obs", ["leadtime", "node"], skills)

    query(survey_id, wide_sql("v_pairs", "z_pred", "z_obs", "leadtime, node", skills), name)(build)


_family("skill_magnitude", "F1", sk.MAGNITUDE)
_family("skill_average", "F2", sk.AVERAGE)
_family("skill_variability", "F3", sk.VARIABILITY)
_family("skill_pearson", "F4", sk.CORRELATION)
_family("skill_overall", "F7", sk.OVERALL)

_SPEARMAN = """
WITH r AS (SELECT node, rank() OVER (PARTITION BY node ORDER BY price) + (count(*) OVER (PARTITION BY node, price) - 1) / 2.0::DOUBLE AS rp,
           rank() OVER (PARTITION BY node ORDER BY qty) + (count(*) OVER (PARTITION BY node, qty) - 1) / 2.0::DOUBLE AS ro FROM v_clim),
m AS (SELECT node, count(*) AS n, covar_pop(rp, ro) / nullif(stddev_pop(rp) * stddev_pop(ro), 0) AS r FROM r GROUP BY 1)
SELECT node, n, r AS spearman_R, r * r AS spearman_R2, r * sqrt((n - 2) / nullif(1 - r * r, 0)) AS spearman_t,
       CAST(n - 2 AS DOUBLE) AS spearman_dof FROM m"""


@query("F5", _SPEARMAN)
def skill_spearman(t: Tables):
    return verify.spearman(t.clim, "price", "qty", ["node"])


def _p_sql(t: str, dof: str) -> str:
    """Two-sided tail of Student's t for whole degrees of freedom: a finite sum over even powers of a cosine."""
    c2, s = f"({dof} / ({dof} + {t} * {t}))", f"(abs({t}) / sqrt({dof} + {t} * {t}))"
    odd = f"list_sum(list_transform(range(0, CAST(({dof} - 1) / 2 AS BIGINT)), lambda k: exp(lgamma(k + 1.0::DOUBLE) - lgamma(k + 1.5::DOUBLE)) * sqrt(pi()) / 2 * pow({c2}, k)))"
    even = f"list_sum(list_transform(range(0, CAST({dof} / 2 AS BIGINT)), lambda k: exp(lgamma(k + 0.5::DOUBLE) - lgamma(k + 1.0::DOUBLE)) / sqrt(pi()) * pow({c2}, k)))"
    return (f"CASE WHEN {t} IS NULL OR {dof} IS NULL OR {dof} <= 0 THEN NULL WHEN CAST({dof} AS BIGINT) % 2 = 1 "
            f"THEN 1 - 2 / pi() * (asin({s}) + {s} * sqrt({c2}) * coalesce({odd}, 0)) ELSE 1 - {s} * {even} END")


_BOTH = f"""
WITH p AS ({wide_sql("v_clim", "price", "qty", "node", sk.CORRELATION)}), s AS ({_SPEARMAN.strip()})
SELECT p.*, s.spearman_R, s.spearman_R2, s.spearman_t, s.spearman_dof FROM p JOIN s ON s.node = p.node"""


@query("F6", f"SELECT *, {_p_sql('pearson_t', 'pearson_dof')} AS pearson_R_pvalue, {_p_sql('spearman_t', 'spearman_dof')} AS spearman_R_pvalue FROM ({_BOTH})")
def skill_pvalue(t: Tables):
    """p values of both correlations."""
    pearson = sk.skill_columns(t.clim, "price", "qty", ["node"], sk.CORRELATION)
    spearman = verify.spearman(t.clim, "price", "qty", ["node"]).drop("n")
    both = pearson.join(spearman, "node")
    both = verify.pvalues(both, "pearson_t", "pearson_dof", "pearson_R_pvalue")
    return verify.pvalues(both, "spearman_t", "spearman_dof", "spearman_R_pvalue")


@query("F8", long_sql("v_pairs", "z_pred", "z_obs", "leadtime, node", sk.ALL_SKILLS))
def deterministic(t: Tables):
    return verify.deterministic(t.fcst_pairs, ["z"], ["leadtime", "node"])


_PERS = (f"(SELECT a.node, a.time AS frt, CAST(l AS INTEGER) AS leadtime, a.z AS z_pred, b.z AS z_obs FROM v_obs a, "
         f"(SELECT unnest(range(6, 235, 6)) AS l), v_obs b WHERE b.node = a.node AND b.time = a.time + {hours('l')})")


@query("F9", long_sql(_PERS, "z_pred", "z_obs", "leadtime, node", ["BIAS", "RMSE", "rSD", "pearson_R", "NSE"]))
def persistence_skill(t: Tables):
    return verify.persistence_skill(t.obs, PERSISTENCE_LEADS, ["z"], skills=["BIAS", "RMSE", "rSD", "pearson_R", "NSE"])


_CLIM_FCST = ("(SELECT v.node, v.time, c.mean_qty AS p, v.qty AS o FROM v_clim v JOIN (SELECT node, {part}(time) AS g, "
              "avg(qty) AS mean_qty FROM v_clim WHERE time <= TIMESTAMP '1999-12-31' GROUP BY 1, 2) c "
              "ON c.node = v.node AND c.g = {part}(v.time) WHERE v.time >= TIMESTAMP '2000-01-01')")


def _climatology_skill(name: str, groups: str, part: str):
    def build(t: Tables):
        clim = scalers.climatology(t.clim, ["qty"], groups, (None, "1999-12-31"))
        test = t.clim.where(F.col("time") >= F.lit("2000-01-01").cast("timestamp_ntz")).select("node", "time", "qty")
        return verify.climatology_skill(test, clim, groups, ["qty"])

    query("F10", long_sql(_CLIM_FCST.format(part=part), "p", "o", "node", sk.ALL_SKILLS, "qty"), name)(build)


_climatology_skill("climatology_skill_month", "month", "month")
_climatology_skill("climatology_skill_week", "weekofyear", "week")

_SUMMARY = ["BIAS", "MAE", "RMSE", "rSD", "pearson_R", "KGE"]


@query("F11", f"""
SELECT skill, leadtime, sum(value * area) / sum(CASE WHEN value IS NOT NULL THEN area END) AS value
FROM ({long_sql('v_pairs', 'z_pred', 'z_obs', 'leadtime, node', _SUMMARY)}) s JOIN v_nodes n ON n.node = s.node
GROUP BY 1, 2""")
def global_summary(t: Tables):
    skills = verify.deterministic(t.fcst_pairs, ["z"], ["leadtime", "node"], _SUMMARY)
    return verify.global_summary(skills, t.nodes, ["skill", "leadtime"])


@query("F9+F11", f"""
SELECT leadtime, skill, sum(value * area) / sum(CASE WHEN value IS NOT NULL THEN area END) AS value
FROM ({long_sql(_PERS, 'z_pred', 'z_obs', 'leadtime, node', _SUMMARY)}) s JOIN v_nodes n ON n.node = s.node
GROUP BY 1, 2""")
def persistence_skill_global(t: Tables):
    """Flagship: persistence skill per lead time, area-weighted over the sphere."""
    skills = verify.persistence_skill(t.obs, PERSISTENCE_LEADS, ["z"], skills=_SUMMARY)
    return verify.global_summary(skills, t.nodes, ["leadtime", "skill"]).orderBy("leadtime", "skill")


def _band(name: str, dim: str, fn):
    sql = (f"SELECT skill, leadtime, floor({dim} / 5) * 5 AS {dim}_band, avg(value) AS value FROM "
           f"({long_sql('v_pairs', 'z_pred', 'z_obs', 'leadtime, node', ['BIAS', 'RMSE'])}) s "
           "JOIN v_nodes n ON n.node = s.node GROUP BY 1, 2, 3")

    def build(t: Tables):
        skills = verify.deterministic(t.fcst_pairs, ["z"], ["leadtime", "node"], ["BIAS", "RMSE"])
        return fn(skills, t.nodes, ["skill", "leadtime"])

    query("F12", sql, name)(build)


_band("latitudinal_summary", "lat", verify.latitudinal_summary)
_band("longitudinal_summary", "lon", verify.longitudinal_summary)

_IDEAL_SQL = ("CASE WHEN skill IN (" + ", ".join(f"'{s}'" for s, v in sk.IDEAL.items() if v == 0) + ") THEN 0.0::DOUBLE "
              "WHEN skill IN (" + ", ".join(f"'{s}'" for s, v in sk.IDEAL.items() if v == 1) + ") THEN 1.0::DOUBLE END")
_B = ["BIAS", "RMSE", "rSD", "pearson_R", "NSE"]


@query("F13", f"""
WITH m AS ({long_sql('v_pairs', 'z_pred', 'z_obs', 'leadtime', _B)}),
p AS ({long_sql(_PERS, 'z_pred', 'z_obs', 'leadtime', _B)}),
c0 AS (SELECT v.node, v.time, c.m AS p, v.z AS o FROM v_obs v JOIN (SELECT node, hour(time) AS h, avg(z) AS m FROM v_obs
       GROUP BY 1, 2) c ON c.node = v.node AND c.h = hour(v.time)),
c AS (SELECT skill, value FROM ({long_sql('(SELECT 1 AS one, p, o FROM c0)', 'p', 'o', 'one', _B)})),
k AS (SELECT m.skill, m.leadtime, m.value AS model, p.value AS persistence, c.value AS climatology FROM m
      JOIN p ON p.skill = m.skill AND p.leadtime = m.leadtime JOIN c ON c.skill = m.skill)
SELECT skill, leadtime, model, persistence, climatology, abs(model - {_IDEAL_SQL}) AS model_distance,
       abs(persistence - {_IDEAL_SQL}) AS persistence_distance, abs(climatology - {_IDEAL_SQL}) AS climatology_distance FROM k""")
def benchmark(t: Tables):
    """Model against persistence and a climatology that has no lead time."""
    model = verify.deterministic(t.fcst_pairs, ["z"], ["leadtime"], _B)
    persistence = verify.persistence_skill(t.obs, PERSISTENCE_LEADS, ["z"], ["leadtime"], _B)
    clim = scalers.climatology(t.obs, ["z"], "hour")
    climatology = verify.climatology_skill(t.obs, clim, "hour", ["z"], [], _B)
    return verify.benchmark({"model": model, "persistence": persistence, "climatology": climatology}, LEADS)


@query("F14", f"""
WITH s AS (SELECT leadtime, skill, value FROM ({long_sql('v_pairs', 'z_pred', 'z_obs', 'leadtime, node', ['BIAS', 'RMSE'])})),
b AS (SELECT leadtime, skill, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
      quantile_cont(value, 0.75) AS q3 FROM s GROUP BY 1, 2)
SELECT b.leadtime, b.skill, q1, median, q3, min(value) AS whisker_low, max(value) AS whisker_high
FROM b JOIN s ON s.leadtime = b.leadtime AND s.skill = b.skill AND value >= q1 - (q3 - q1) * 1.5 AND value <= q3 + (q3 - q1) * 1.5
GROUP BY 1, 2, 3, 4, 5""")
def skill_distribution(t: Tables):
    skills = verify.deterministic(t.fcst_pairs, ["z"], ["leadtime", "node"], ["BIAS", "RMSE"])
    return verify.skill_distribution(skills, ["leadtime", "skill"])


_WSE = "SELECT p.node, frt, leadtime, area * (z_pred - z_obs) * (z_pred - z_obs) AS z_wse FROM v_pairs p JOIN v_nodes n ON n.node = p.node"


@query("F15", f"SELECT (SELECT sum(z_wse) FROM ({_WSE})) / (SELECT sum(area) FROM v_nodes) / "
              "(SELECT count(*) FROM (SELECT DISTINCT frt, leadtime FROM v_pairs)) AS weighted_mse")
def weighted_mse_mean(t: Tables):
    return verify.weighted_mse(t.fcst_pairs, t.nodes, ["z"], ["frt", "leadtime"], "mean")


@query("F15", f"SELECT (SELECT sum(z_wse) FROM ({_WSE})) * (SELECT count(*) FROM v_nodes) AS weighted_mse")
def weighted_mse_sum(t: Tables):
    return verify.weighted_mse(t.fcst_pairs, t.nodes, ["z"], ["frt", "leadtime"], "sum")


@query("F15", _WSE)
def weighted_mse_none(t: Tables):
    return verify.weighted_mse(t.fcst_pairs, t.nodes, ["z"], ["frt", "leadtime"], "none")


_MEDIAN = "(SELECT frt, leadtime, node, quantile_cont(z, 0.5) AS z FROM v_ens GROUP BY 1, 2, 3)"


@query("F16", long_sql(f"(SELECT m.leadtime, m.node, m.z AS z_pred, o.z AS z_obs FROM {_MEDIAN} m JOIN v_obs o ON "
                       f"o.node = m.node AND o.time = m.frt + {hours('m.leadtime')})",
                       "z_pred", "z_obs", "leadtime", sk.ALL_SKILLS))
def ensemble_median(t: Tables):
    median = verify.ensemble_median(t.ens, ["z"], members=MEMBERS)
    pairs = align.forecast_error(median, t.obs, ["z"])
    return verify.deterministic(pairs, ["z"], ["leadtime"])


@query("F17", "SELECT leadtime + 6 AS leadtime, node, count(*) AS n, avg(z) AS z FROM v_fcst GROUP BY 1, 2")
def shift_leadtime(t: Tables):
    return verify.shift_leadtime(t.fcst, 6).groupBy("leadtime", "node").agg(
        F.count(F.lit(1)).alias("n"), F.avg("z").alias("z"))


# --- Hovmoller diagrams ------------------------------------------------------------------------


@query("G1", "SELECT time, floor(lat / 5) * 5 AS lat_bin, avg(z) AS z FROM v_obs o JOIN v_nodes n ON n.node = o.node GROUP BY 1, 2")
def hovmoller_lat(t: Tables):
    return hovmoller.hovmoller(t.obs, t.nodes, ["z"])


@query("G1", """
WITH a AS (SELECT node, week(time) AS weekofyear, avg(z) AS z FROM v_obs GROUP BY 1, 2)
SELECT weekofyear, floor(lat / 10) * 10 AS lat_bin, avg(z) AS z FROM a JOIN v_nodes n ON n.node = a.node GROUP BY 1, 2""")
def hovmoller_lat_week(t: Tables):
    return hovmoller.hovmoller(t.obs, t.nodes, ["z"], bin_width=10, groups="weekofyear")


@query("G1", """
WITH a AS (SELECT node, dayofyear(time) AS dayofyear, hour(time) AS hour, avg(z) AS z FROM v_obs GROUP BY 1, 2, 3)
SELECT dayofyear, hour, floor(lat / 5) * 5 AS lat_bin, avg(z) AS z FROM a JOIN v_nodes n ON n.node = a.node GROUP BY 1, 2, 3""")
def hovmoller_lat_day_hour(t: Tables):
    return hovmoller.hovmoller(t.obs, t.nodes, ["z"], groups=["dayofyear", "hour"])


@query("G1", """
WITH a AS (SELECT node, hour(time) - hour(time) % 12 AS hour, avg(z) AS z FROM v_obs GROUP BY 1, 2)
SELECT hour, floor(lat / 5) * 5 AS lat_bin, avg(z) AS z FROM a JOIN v_nodes n ON n.node = a.node GROUP BY 1, 2""")
def hovmoller_lat_hour_width(t: Tables):
    return hovmoller.hovmoller(t.obs, t.nodes, ["z"], groups={"hour": 12})


@query("G2", "SELECT week(time) AS weekofyear, floor(lat / 10) * 10 AS lat_bin, avg(z) AS z FROM v_obs o "
             "JOIN v_nodes n ON n.node = o.node GROUP BY 1, 2")
def hovmoller_rows(t: Tables):
    return hovmoller.hovmoller(t.obs, t.nodes, ["z"], bin_width=10, groups="weekofyear", average_first=False)


@query("G3", "SELECT time, floor(lon / 15) * 15 AS lon_bin, avg(z) AS z FROM v_obs o JOIN v_nodes n ON n.node = o.node GROUP BY 1, 2")
def hovmoller_lon(t: Tables):
    return hovmoller.hovmoller(t.obs, t.nodes, ["z"], "lon", 15)


@query("G4", """
WITH a AS (SELECT leadtime, node, dayofyear(time) AS dayofyear, avg(z_pred) AS p, avg(z_obs) AS o, avg(z_pred - z_obs) AS e
           FROM v_pairs GROUP BY 1, 2, 3),
h AS (SELECT leadtime, dayofyear, floor(lat / 5) * 5 AS lat_bin, avg(p) AS z_pred, avg(o) AS z_obs, avg(e) AS z_err
      FROM a JOIN v_nodes n ON n.node = a.node GROUP BY 1, 2, 3)
SELECT *, z_pred - z_obs AS z_diff, abs(z_pred - z_obs - z_err) < 1e-9 AS closes FROM h""")
def hovmoller_diff(t: Tables):
    diagram = hovmoller.hovmoller_diff(t.fcst_pairs, t.nodes, ["z"], groups="dayofyear", by=["leadtime"])
    return diagram.withColumn("closes", F.abs("z_residual") < 1e-9).drop("z_residual")
