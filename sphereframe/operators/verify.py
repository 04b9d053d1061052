"""Forecast verification: scores, summaries, comparison tables, ensembles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import skill as sk
from ..functions.columns import TimeGroups, safe_div, value_bin
from ..functions.ranks import centred_ranks, exact_quantiles
from ..functions.special import t_pvalue
from ..session import cut_lineage
from . import align


def deterministic(pairs: DataFrame, variables: Sequence[str], by: Sequence[str],
                  skills: Sequence[str] = sk.ALL_SKILLS) -> DataFrame:
    """Long skill table (<by>, variable, skill, value) of aligned ``<v>_pred``/``<v>_obs`` pairs.

    One aggregation for all variables and scores.
    """
    return sk.skill_table(pairs, {v: (f"{v}_pred", f"{v}_obs") for v in variables}, by, skills)


def spearman(pairs: DataFrame, pred: str, obs: str, by: Sequence[str]) -> DataFrame:
    """Rank correlation (average ranks for ties), its square and t statistic.

    Pairs are first collapsed to distinct (pred, obs) with a count, in one pass
    over the input; ranks come from bucketed exact counting, so no group is
    ordered in one task.
    """
    by = list(by)
    distinct = cut_lineage(
        pairs.where(F.col(pred).isNotNull() & F.col(obs).isNotNull())
        .groupBy(*by, F.col(pred).alias("_p"), F.col(obs).alias("_o")).agg(F.count(F.lit(1)).alias("_w")))
    # Ranks count from the middle of their group, so no large sums have to cancel.
    rank_p = centred_ranks(distinct, by, "_p", "_w").withColumnRenamed("rank", "_rp")
    rank_o = centred_ranks(distinct, by, "_o", "_w").withColumnRenamed("rank", "_ro")
    ranked = distinct.join(rank_p, [*by, "_p"]).join(rank_o, [*by, "_o"])
    w, rp, ro = F.col("_w"), F.col("_rp"), F.col("_ro")
    sums = ranked.groupBy(*by).agg(F.sum(w).alias("n"), F.sum(w * rp * ro).alias("_spo"),
                                   F.sum(w * rp * rp).alias("_spp"), F.sum(w * ro * ro).alias("_soo"))
    n = F.col("n")
    r = safe_div(F.col("_spo"), F.sqrt("_spp") * F.sqrt("_soo"))
    out = sums.select(*by, n, r.alias("spearman_R"))
    r = F.col("spearman_R")
    return out.withColumns({"spearman_R2": r * r,
                            "spearman_t": F.when(n > 2, sk.t_statistic(r, n)),
                            "spearman_dof": F.when(n > 2, (n - 2).cast("double"))})


def pvalues(skills: DataFrame, t: str, dof: str, output: str) -> DataFrame:
    """Two-sided p value of t statistics on the already aggregated skill rows."""
    return skills.withColumn(output, t_pvalue(F.col(t), F.col(dof)))


def persistence_skill(obs: DataFrame, leads: Sequence[int], variables: Sequence[str],
                      by: Sequence[str] = ("leadtime", "node"), skills: Sequence[str] = sk.ALL_SKILLS) -> DataFrame:
    """Scores of the persistence forecast for all leads in one job."""
    return deterministic(align.persistence_forecast(obs, leads, variables), variables, by, skills)


def climatology_skill(obs: DataFrame, clim: DataFrame, groups: TimeGroups, variables: Sequence[str],
                      by: Sequence[str] = ("node",), skills: Sequence[str] = sk.ALL_SKILLS) -> DataFrame:
    """Scores of the climatological forecast; it has no lead time."""
    fcst = align.climatology_forecast(obs, clim, groups)
    pairs = fcst.withColumnsRenamed({f"mean_{v}": f"{v}_pred" for v in variables} | {v: f"{v}_obs" for v in variables})
    return deterministic(pairs, variables, by, skills)


def global_summary(skills: DataFrame, nodes: DataFrame, by: Sequence[str], value: str = "value",
                   area: str = "area") -> DataFrame:
    """Area-weighted mean over nodes of a skill table."""
    w = F.when(F.col(value).isNotNull(), F.col(area))
    joined = skills.join(nodes.select("node", area), "node")
    return joined.groupBy(*by).agg(safe_div(F.sum(F.col(value) * w), F.sum(w)).alias(value))


def band_summary(skills: DataFrame, nodes: DataFrame, dim: str, by: Sequence[str], value: str = "value",
                 resolution: float = 5.0) -> DataFrame:
    """Mean per latitude (``dim='lat'``) or longitude (``'lon'``) band."""
    band = f"{dim}_band"
    joined = skills.join(nodes.select("node", value_bin(dim, resolution).alias(band)), "node")
    return joined.groupBy(*by, band).agg(F.avg(value).alias(value))


def latitudinal_summary(skills: DataFrame, nodes: DataFrame, by: Sequence[str], resolution: float = 5.0) -> DataFrame:
    return band_summary(skills, nodes, "lat", by, resolution=resolution)


def longitudinal_summary(skills: DataFrame, nodes: DataFrame, by: Sequence[str], resolution: float = 5.0) -> DataFrame:
    return band_summary(skills, nodes, "lon", by, resolution=resolution)


def benchmark(tables: Mapping[str, DataFrame], leads: Sequence[int], skill: str = "skill",
              leadtime: str = "leadtime", value: str = "value") -> DataFrame:
    """Comparison of forecasts: one column per forecast and its distance to the ideal score.

    Tables without a lead time (climatologies) are constant over ``leads``.
    """
    lead_list = F.array(*[F.lit(int(h)) for h in leads])
    parts = []
    for name, df in tables.items():
        lead = F.col(leadtime) if leadtime in df.columns else F.lit(None).cast("int")
        fanned = df.select(skill, value, F.explode(
            F.when(lead.isNull(), lead_list).otherwise(F.array(lead.cast("int")))).alias(leadtime))
        parts.append(fanned.where(F.col(leadtime).isin([int(h) for h in leads])).withColumn("forecast", F.lit(name)))
    names = list(tables)
    wide = (reduce(DataFrame.unionByName, parts).groupBy(skill, leadtime)
            .pivot("forecast", names).agg(F.first(value)))
    zero = [s for s, v in sk.IDEAL.items() if v == 0.0]
    one = [s for s, v in sk.IDEAL.items() if v == 1.0]
    ideal = F.when(F.col(skill).isin(zero), F.lit(0.0)).when(F.col(skill).isin(one), F.lit(1.0))
    return wide.withColumns({f"{n}_distance": F.abs(F.col(n) - ideal) for n in names})


def skill_distribution(skills: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Box statistics over nodes: quartiles and whiskers within 1.5 interquartile ranges."""
    by = list(by)
    skills = cut_lineage(skills.select(*by, value))
    box = exact_quantiles(skills, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = (F.col(value) >= F.col("q1") - reach) & (F.col(value) <= F.col("q3") + reach)
    whiskers = (skills.join(box, by).where(inside).groupBy(*by)
                .agg(F.min(value).alias("whisker_low"), F.max(value).alias("whisker_high")))
    return box.join(whiskers, by)


def weighted_mse(pairs: DataFrame, nodes: DataFrame, variables: Sequence[str], sample: Sequence[str],
                 reduction: str = "mean", area: str = "area") -> DataFrame:
    """Area-weighted squared error over samples, nodes and variables.

    ``mean``: sum of w*e^2 over total weight, samples and variables; ``sum``:
    sum of w*e^2 times the number of nodes; ``none``: one value per pair.  A
    NULL takes only its own variable out of a sum.
    """
    if reduction not in ("mean", "sum", "none"):
        raise ValueError(f"{reduction!r} is not a valid reduction")
    joined = pairs.join(nodes.select("node", area), "node")
    squares = {v: F.col(area) * (F.col(f"{v}_pred") - F.col(f"{v}_obs")) * (F.col(f"{v}_pred") - F.col(f"{v}_obs"))
               for v in variables}
    if reduction == "none":
        return joined.select("node", *sample, *[c.alias(f"{v}_wse") for v, c in squares.items()])
    per_sample = joined.groupBy(*sample).agg(F.sum(sum((F.coalesce(c, F.lit(0.0)) for c in squares.values()), F.lit(0.0))).alias("_s"))
    total = per_sample.agg(F.sum("_s").alias("_s"), F.count(F.lit(1)).alias("_batch"))
    weights = nodes.agg(F.struct(F.sum(area).alias("w"), F.count(F.lit(1)).alias("n")).alias("_w")).scalar()
    if reduction == "sum":
        return total.select((F.col("_s") * weights["n"]).alias("weighted_mse"))
    return total.select(
        (F.col("_s") / weights["w"] / F.col("_batch") / F.lit(float(len(variables)))).alias("weighted_mse"))


def ensemble_median(ens: DataFrame, variables: Sequence[str], keys: Sequence[str] = ("frt", "leadtime", "node"),
                    members: Sequence[int] | None = None) -> DataFrame:
    """Exact median over members.

    With the member numbers given, members become plain columns (a codegen'd
    hash aggregate that combines map-side) and the median is an expression over
    them.  A group never holds more rows than the ensemble has members.  A member
    that is not among the given ones stops the query.
    """
    if members is None:
        return ens.groupBy(*keys).agg(*[F.median(v).alias(v) for v in variables])
    aggs = [F.max(F.when(F.col("member") == int(m), F.col(v))).alias(f"_{v}_{m}") for v in variables for m in members]
    listed = F.coalesce(F.col("member").isin([int(m) for m in members]), F.lit(False))
    # Numbers only: a string among them would make Spark sort all rows of all members by their keys.
    wide = ens.groupBy(*keys).agg(*aggs, F.max(F.when(~listed, F.col("member"))).alias("_other"), F.max(F.when(F.col("member").isNull(), 1)).alias("_none"))
    for v in variables:
        wide = wide.withColumn(f"_{v}", F.array_sort(F.array_compact(F.array(*[F.col(f"_{v}_{m}") for m in members]))))
    at = lambda v, i: F.get(F.col(f"_{v}"), i.cast("int"))
    n = {v: F.size(f"_{v}") for v in variables}
    stop = F.raise_error(F.concat(F.lit("a member is not among the given ones: "), F.coalesce(F.col("_other").cast("string"), F.lit("NULL")))).cast("double")
    median = {v: (at(v, F.floor((n[v] - 1) / 2)) + at(v, F.floor(n[v] / 2))) / 2.0 for v in variables}
    return wide.select(*keys, *[F.when(F.col("_other").isNotNull() | F.col("_none").isNotNull(), stop).otherwise(m).alias(v) for v, m in median.items()])


def shift_leadtime(df: DataFrame, hours: int, leadtime: str = "leadtime") -> DataFrame:
    """Relabel lead times."""
    return df.withColumn(leadtime, (F.col(leadtime) + F.lit(int(hours))).cast("int"))
