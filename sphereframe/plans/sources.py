"""Queries over readers and writers."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sources
from ..session import cut_lineage, scratch_path
from .registry import query
from .views import Tables


@query("A1", "SELECT node, time, z FROM v_obs WHERE time BETWEEN TIMESTAMP '2024-01-05 06:00:00' "
             "AND TIMESTAMP '2024-01-20 18:00:00'")
def read_grid(t: Tables):
    return sources.read_grid(t.obs, ["z"], "2024-01-05T06:00:00", "2024-01-20T18:00:00")


@query("A2", """
SELECT 'file=' || strftime(ts, '%Y_%m_%d') AS file_name, event_id, ts AS time, user_id AS node, value FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-03 12:00:00' AND TIMESTAMP '2024-01-25 06:00:00'""")
def read_raw(t: Tables):
    """One raw file per day, re-read through a glob with a time filter."""
    path = scratch_path(t.spark, "raw")
    raw = t.table("events").select("event_id", F.col("ts").alias("time"), F.col("user_id").alias("node"), "value")
    (raw.withColumn("file", F.date_format("time", "yyyy_MM_dd")).hint("rebalance", "file")
        .write.partitionBy("file").parquet(path))
    return (sources.read_raw(t.spark, f"{path}/file=*", r"file=\d{4}_\d{2}_\d{2}", "time",
                             "2024-01-03T12:00:00", "2024-01-25T06:00:00")
            .select("file_name", "event_id", "time", "node", "value"))


@query("A3", "SELECT node, time, CASE WHEN time >= TIMESTAMP '1999-07-01' AND time < TIMESTAMP '1999-08-01' "
             "THEN qty + 1 ELSE qty END AS qty, price, disc FROM v_clim")
def write_grid(t: Tables):
    """Create, append along time, then replace one month in place; read everything back."""
    path = scratch_path(t.spark, "grid")
    early = F.col("time") < F.lit("1998-06-15").cast("timestamp_ntz")
    clim = cut_lineage(t.clim)
    sources.write_grid(clim.where(early), path)
    sources.write_grid(clim.where(~early), path, "append")
    july = (F.year("time") == 1999) & (F.month("time") == 7)
    sources.write_grid(clim.where(july).withColumn("qty", F.col("qty") + 1), path, "update")
    return sources.read_grid(path, ["qty", "price", "disc"], spark=t.spark)


@query("A4", "SELECT node, time, qty, price, disc FROM v_clim")
def relayout_by_node(t: Tables):
    return sources.relayout(t.clim, "node")


@query("A4", "SELECT node, time, qty, price, disc FROM v_clim")
def relayout_by_time(t: Tables):
    return sources.relayout(t.clim, "time")


@query("A5", """
WITH s AS (SELECT avg(qty) AS mean_qty, stddev_pop(qty) AS std_qty FROM v_clim)
SELECT node, time, (qty - mean_qty) / std_qty AS qty FROM v_clim, s""")
def stats_round_trip(t: Tables):
    """Fit, persist, reload and apply a scaler."""
    from ..operators import scalers

    path = scratch_path(t.spark, "stats")
    sources.save_stats(scalers.standard_fit(t.clim, ["qty"]), path)
    stats = sources.load_stats(t.spark, path)
    return scalers.standard_transform(t.clim, stats, ["qty"]).select("node", "time", "qty")


@query("A6", """
WITH s AS (SELECT leadtime, node, avg(z_pred - z_obs) AS bias FROM v_pairs GROUP BY 1, 2)
SELECT 'own' AS forecast, 'BIAS' AS skill, leadtime, node, bias AS value FROM s
UNION ALL SELECT 'foreign', 'BIAS', leadtime, node, bias * 9.80665::DOUBLE FROM s""")
def read_skills(t: Tables):
    """Two experiments, one of which names and scales its columns differently."""
    skill = t.fcst_pairs.groupBy("leadtime", "node").agg(F.avg(F.col("z_pred") - F.col("z_obs")).alias("value"))
    own = sources.read_skills({"own": skill}, defaults={"skill": "BIAS"})
    foreign = skill.withColumnRenamed("leadtime", "lead_time")
    other = sources.read_skills({"foreign": foreign}, rename={"lead_time": "leadtime"}, scale={"value": 9.80665},
                                defaults={"skill": "BIAS"})
    cols = ["forecast", "skill", "leadtime", "node", "value"]
    return own.select(cols).unionByName(other.select(cols))


@query("A7", """
SELECT s_suppkey AS node, s_acctbal AS orog, s_nationkey AS slt, r_name AS zone
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def merge_static(t: Tables):
    s = t.table("supplier")
    zone = (t.table("nation").join(t.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select("n_nationkey", "r_name", F.lit(0.0).alias("lev")))
    files = [s.select(F.col("s_suppkey").alias("node"), F.col("s_acctbal").alias("z"), F.lit(0).alias("lon_bnds")),
             s.select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("var43")),
             s.join(zone, s["s_nationkey"] == zone["n_nationkey"]).select(
                 F.col("s_suppkey").alias("node"), F.col("r_name").alias("zone"), "lev")]
    return sources.merge_static(files, "node", ["lon_bnds", "lev"], {"z": "orog", "var43": "slt"})


@query("A8", """
SELECT o.node, o.time, z, tisr, s.s_nationkey AS slt FROM v_obs o LEFT JOIN v_bc b ON o.node = b.node AND o.time = b.time
LEFT JOIN supplier s ON s.s_suppkey = o.node
WHERE o.time BETWEEN TIMESTAMP '2024-01-08 00:00:00' AND TIMESTAMP '2024-01-14 18:00:00'""")
def extract_toy(t: Tables):
    toy = sources.extract_toy({"dynamic": t.obs, "bc": t.bc, "static": t.static},
                              "2024-01-08T00:00:00", "2024-01-14T18:00:00")
    return (toy["dynamic"].join(toy["bc"], ["node", "time"], "left").join(toy["static"], "node", "left")
            .select("node", "time", "z", "tisr", "slt"))


@query("A9", "SELECT frt, leadtime, node, round(z * sqrt(0.5::DOUBLE), 3) AS z, round(z * sqrt(0.3::DOUBLE), 1) AS t FROM v_fcst")
def round_on_write(t: Tables):
    both = t.fcst.select("frt", "leadtime", "node", (F.col("z") * F.sqrt(F.lit(0.5))).alias("z"),
                         (F.col("z") * F.sqrt(F.lit(0.3))).alias("t"))
    return sources.round_on_write(both, {"z": 3, "t": 1})


@query("A10", """
SELECT doc_id, '/native/' || source || '/' || doc_id || '.grb' AS path,
       '/remapped/' || source || '/' || doc_id || '.nc' AS target
FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def pending_files(t: Tables):
    """Documents play the input files, labelled ones those already processed."""
    docs = t.table("documents").select("doc_id", F.concat(
        F.lit("/native/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".grb")).alias("path"))
    done = (t.table("labels").select("doc_id").join(t.table("documents").select("doc_id", "source"), "doc_id")
            .select(F.concat(F.lit("/remapped/"), "source", F.lit("/"), F.col("doc_id").cast("string"),
                             F.lit(".nc")).alias("done")))
    return sources.pending_files(docs, done, "path", "done", "/native/", "/remapped/", ".grb", ".nc").select(
        "doc_id", "path", "target")
