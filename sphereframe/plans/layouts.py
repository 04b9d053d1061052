"""Queries over stores that grow: node-contiguous tables, ingest of batches, ensembles written member by member."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import sources
from ..functions import skill as sk
from ..functions.columns import truncate_hours
from ..operators import align, scalers, select, verify
from ..operators.reshape import unstack_levels
from ..session import scratch_path
from .registry import query
from .reshaping import LEVEL_NAMES
from .statistics import _MONTH, VARS, _fit_sql
from .verification import long_sql
from .views import EVENT_TYPES, MEMBERS, Tables, hours


def bucketed(t: Tables, df: DataFrame, name: str) -> DataFrame:
    """``df`` as a node-contiguous catalogue table under a name of its own."""
    table = f"{name}_{uuid.uuid4().hex}"
    buckets = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    sources.write_bucketed(df, table, scratch_path(t.spark, name), buckets)
    return sources.read_bucketed(t.spark, table)


@query("A4", _fit_sql("v_clim", VARS, _MONTH, ""))
def climatology_bucketed(t: Tables):
    """Climatology by node from the node-contiguous table: no exchange behind the scan."""
    return scalers.climatology(bucketed(t, t.clim, "clim"), VARS, "month")


@query("A4", long_sql("v_pairs", "z_pred", "z_obs", "leadtime, node", sk.ALL_SKILLS))
def deterministic_bucketed(t: Tables):
    """Scores by (leadtime, node) of forecast and truth stored node-contiguously."""
    pairs = t.fcst_pairs.select("node", "time", "leadtime", "z_pred", "z_obs")
    return verify.deterministic(bucketed(t, pairs, "pairs"), ["z"], ["leadtime", "node"])


@query("A4", "SELECT node, count(*) AS steps, CAST(1 AS BIGINT) AS files, CAST(0 AS BIGINT) AS unordered FROM v_clim GROUP BY node")
def layout_by_node(t: Tables):
    """What the node-contiguous layout promises, read off the stored files: a node lies in one file, its steps in rising order, side by side."""
    rows = bucketed(t, t.clim, "layout").select("node", "time", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    steps = rows.groupBy("node").agg(F.count(F.lit(1)).alias("steps"), F.count_distinct("file").alias("files"), F.min("row").alias("first"),
                                     F.array_sort(F.collect_list(F.struct("time", "row"))).alias("_in_order"))
    # in the order of time, the rows of a node are numbered without a hole (a node has a row for each day at most)
    wrong = F.size(F.filter("_in_order", lambda s, i: s["row"] != F.col("first") + i)).cast("long")
    return steps.select("node", "steps", "files", wrong.alias("unordered"))


_STEP = f"date_trunc('day', ts) + {hours('6 * (hour(ts) // 6)')}"
_LEVELS = ", ".join(f"max(CASE WHEN event_type = '{e}' AND event_id % 3 = {k} THEN value END) AS {e}{p}" for e in EVENT_TYPES for k, p in ((0, 500), (1, 850), (2, 1000)))


@query("A3", f"""
WITH s AS (SELECT user_id AS node, {_STEP} AS time, {_LEVELS} FROM events GROUP BY 1, 2)
SELECT 'stored' AS kind, node, time, CAST(NULL AS TIMESTAMP) AS gap_end, CAST(NULL AS BIGINT) AS missing, {", ".join(LEVEL_NAMES)} FROM s
WHERE time < TIMESTAMP '2024-01-21'
UNION ALL SELECT 'gap', NULL, TIMESTAMP '2024-01-15 06:00:00', TIMESTAMP '2024-01-15 18:00:00', 1, {", ".join("NULL" for _ in LEVEL_NAMES)}
UNION ALL SELECT status, NULL, NULL, NULL, n, {", ".join("NULL" for _ in LEVEL_NAMES)} FROM (VALUES ('published', 2::BIGINT), ('known', 1), ('refused', 1)) v(status, n)""")
def ingest_chain(t: Tables):
    """Raw day files, some rows in the file of another month, through repair, gap check, unstacking and publication.

    The first ten days arrive twice; the next ten first without one step, which is refused, and then whole.
    """
    path, store = scratch_path(t.spark, "raw"), scratch_path(t.spark, "store")
    raw = t.table("events").select(F.col("user_id").alias("ncells"), truncate_hours("ts", 6).alias("time"), F.col("event_type").alias("var"), F.pmod("event_id", F.lit(3)).alias("k"),
                                   F.col("value").alias("var129"), F.lit(0.0).alias("lon_bnds"))
    raw = raw.withColumn("plev", F.when(F.col("k") == 0, 50000).when(F.col("k") == 1, 85000).otherwise(100000)).drop("k")
    filed = raw.withColumn("file", F.date_format("time", "'pl'_yyyy_MM_dd"))
    stray = filed.where(F.dayofmonth("time") == 5).withColumn("time", F.col("time") + F.expr("INTERVAL 40 DAYS"))
    filed.unionByName(stray).hint("rebalance", "file").write.partitionBy("file").parquet(path)

    def deliver(days: str, start: str, end: str, without: str | None = None) -> sources.Ingested:
        files = sources.read_raw(t.spark, f"{path}/file=pl_2024_01_{days}", r"pl_\d{4}_\d{2}_\d{2}", "time")
        files = files if without is None else files.where(F.col("time") != F.lit(without).cast("timestamp_ntz"))
        return sources.ingest(files, store, step_hours=6, var_dict={"ncells": "node", "var129": "value"}, drops=["lon_bnds", "file_name"], start=start, end=end,
                              repair=lambda df: select.fix_file_month(df, "file_name"), reshape=lambda df: unstack_levels(df, LEVEL_NAMES, agg=F.max))

    first, second = ("{0[1-9],10}", "2024-01-01", "2024-01-10"), ("{1[1-9],20}", "2024-01-11", "2024-01-20")
    done = [deliver(*first), deliver(*first), deliver(*second, without="2024-01-15T12:00:00"), deliver(*second)]
    schema = "node long, time timestamp_ntz, " + ", ".join(f"{c} double" for c in LEVEL_NAMES)
    stored = sources.read_store(t.spark, store, schema).select(F.lit("stored").alias("kind"), "*")
    gaps = done[2].gaps.select(F.lit("gap").alias("kind"), F.col("gap_start").alias("time"), "gap_end", "missing")
    counts = t.spark.createDataFrame([(s, sum(d.status == s for d in done)) for s in sorted({d.status for d in done})], "kind string, missing long")
    return stored.unionByName(gaps, allowMissingColumns=True).unionByName(counts, allowMissingColumns=True)


_REPLACED = "SELECT frt, leadtime, node, member, CASE WHEN member = 1 THEN z + 0.5::DOUBLE ELSE z END AS z FROM v_ens"
_MEDIAN_STORED = f"(SELECT frt, leadtime, node, quantile_cont(z, 0.5) AS z FROM ({_REPLACED}) GROUP BY 1, 2, 3)"


def _run(t: Tables, m: int) -> DataFrame:
    return t.ens.where(F.col("member") == m).drop("member")


@query("D9", long_sql(f"(SELECT m.leadtime, m.node, m.z AS z_pred, o.z AS z_obs FROM {_MEDIAN_STORED} m JOIN v_obs o ON o.node = m.node AND o.time = m.frt + {hours('m.leadtime')})",
                      "z_pred", "z_obs", "leadtime", sk.ALL_SKILLS))
def ensemble_store(t: Tables):
    """Three members, then two more, then one replaced; scores of the median over the stored ensemble.

    The members of a forecast lie in five files: they are brought together as they are, in tasks that grow with the events, and then aggregated.
    Aggregating before that would gain nothing and spill.
    """
    path = scratch_path(t.spark, "members")
    sources.write_members({m: _run(t, m) for m in MEMBERS[:3]}, path)
    sources.write_members({m: _run(t, m) for m in MEMBERS[3:]}, path)
    sources.write_members({1: _run(t, 1).withColumn("z", F.col("z") + 0.5)}, path, replace=True)
    stored = sources.read_members(t.spark, path).repartition(t.event_tasks, "frt", "node")
    median = verify.ensemble_median(stored, ["z"], members=MEMBERS)
    return verify.deterministic(align.forecast_error(median, t.obs, ["z"]), ["z"], ["leadtime"])


@query("D9", f"SELECT member, count(*) AS n, avg(z) AS z FROM ({_REPLACED}) GROUP BY 1")
def ensemble_members(t: Tables):
    """The stored members after the same writes, each by itself."""
    path = scratch_path(t.spark, "members")
    sources.write_members({m: _run(t, m) for m in MEMBERS}, path)
    sources.write_members({1: _run(t, 1).withColumn("z", F.col("z") + 0.5)}, path, replace=True)
    stored = sources.read_members(t.spark, path)
    return stored.groupBy(F.col("member").cast("int").alias("member")).agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("z"))
