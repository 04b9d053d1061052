"""Autoregressive sample tables: lags, targets, reference times, batches and roll-outs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import shift_hours
from ..functions.ranks import numbered_by_hash
from ..functions.series import HOUR_US, chunk_index, epoch_micros
from ..session import cut_lineage


def lag_name(variable: str, hours: int) -> str:
    """Column of a variable at an offset: ``z_m18``, ``z_p0``, ``z_p6``."""
    return f"{variable}_{'m' if hours < 0 else 'p'}{abs(hours)}"


def window_samples(df: DataFrame, variables: Sequence[str], offsets: Sequence[int]) -> DataFrame:
    """Values at ``time + offset`` hours side by side, for reference times with every offset present.

    One exchange whatever the number of offsets: rows are ordered inside (node,
    chunk of time) and each offset is a one-row RANGE frame behind the latest of
    them, so gaps are respected.  Rows near the end of a chunk are copied to the
    next one; chunks are long against the span, so few are.
    """
    offsets = sorted({int(h) for h in offsets})
    anchor, span = offsets[-1], offsets[-1] - offsets[0]
    chunk = max(30 * 24, 8 * span)
    rows = df.select("node", "time", *variables).withColumn("_chunk", F.explode(F.sequence(
        chunk_index("time", chunk), chunk_index(shift_hours("time", span), chunk))))
    order = W.partitionBy("node", "_chunk").orderBy("_t")
    values, present = {}, F.lit(True)
    for h in offsets:
        back = HOUR_US * (h - anchor)
        frame = order.rangeBetween(back, back)
        present = present & (F.count(F.lit(1)).over(frame) > 0)
        values |= {lag_name(v, h): F.max(v).over(frame) for v in variables}
    rows = rows.withColumn("_t", epoch_micros("time")).withColumns(values | {"_all": present})
    own = F.col("_chunk") == chunk_index("time", chunk)
    return rows.where(own & F.col("_all")).select(
        "node", shift_hours("time", -anchor).alias("time"), *[lag_name(v, h) for v in variables for h in offsets])


def lag_features(df: DataFrame, variables: Sequence[str], input_k: Sequence[int], step_hours: int = 1,
                 with_current: bool = False) -> DataFrame:
    """Predictors at ``t + k`` steps (k negative), optionally with the state at t itself."""
    offsets = [int(k) * step_hours for k in input_k] + ([0] if with_current else [])
    return window_samples(df, variables, offsets)


def targets(df: DataFrame, variables: Sequence[str], output_k: Sequence[int], cycle: int, iterations: int,
            step_hours: int = 1) -> DataFrame:
    """Targets of every autoregressive iteration: (node, time, iteration, k, variables).

    ``time`` is the reference time; the value is that at ``output_k + i*cycle`` steps.
    """
    pairs = [(i, int(k), (int(k) + i * cycle) * step_hours) for i in range(iterations + 1) for k in output_k]
    fan = F.explode(F.array(*[F.struct(F.lit(i).alias("iteration"), F.lit(k).alias("k"), F.lit(h).alias("h"))
                              for i, k, h in pairs]))
    sent = df.select("node", "time", *variables).withColumn("_f", fan)
    return sent.select("node", shift_hours("time", -F.col("_f.h")).alias("time"), "_f.iteration", "_f.k", *variables)


def ar_plan(input_k: Sequence[int], output_k: Sequence[int], cycle: int, iterations: int,
            stack_most_recent: bool = True) -> list[tuple]:
    """(iteration, k, offset, from_iteration, from_k) of every lag of every iteration.

    Offsets no earlier iteration predicts come from observations (the last two
    entries are None).  Where several predicted the step, the latest (or, without
    ``stack_most_recent``, the earliest) iteration is taken.
    """
    pick = max if stack_most_recent else min
    plan = []
    for i in range(iterations + 1):
        for k in input_k:
            offset = int(k) + i * cycle
            made = [(j, int(o)) for j in range(i) for o in output_k if o + j * cycle == offset]
            plan.append((i, int(k), offset, *(pick(made) if made else (None, None))))
    return plan


def ar_inputs(spark: SparkSession, input_k: Sequence[int], output_k: Sequence[int], cycle: int, iterations: int,
              stack_most_recent: bool = True) -> DataFrame:
    """The plan as a table."""
    rows = ar_plan(input_k, output_k, cycle, iterations, stack_most_recent)
    table = spark.createDataFrame(rows, "iteration int, k int, offset int, from_iteration int, from_k int")
    return table.withColumn("source", F.when(F.col("from_k").isNull(), "observation").otherwise("prediction"))


def assemble_inputs(reference: DataFrame, obs: DataFrame, predictions: DataFrame, plan: Sequence[tuple], variable: str,
                    step_hours: int = 1) -> DataFrame:
    """Fill an :func:`ar_plan` for every (node, reference time).

    ``predictions`` holds (node, time, iteration, k, variable).
    """
    def fanned(rows):
        fields = ("iteration", "k", "offset", "from_iteration", "from_k")
        structs = [F.struct(*[F.lit(v).cast("int").alias(f) for f, v in zip(fields, row)]) for row in rows]
        return reference.select("node", "time", F.explode(F.array(*structs)).alias("_r")).select("node", "time", "_r.*")

    observed_rows = [row for row in plan if row[3] is None]
    predicted_rows = [row for row in plan if row[3] is not None]
    cols = ["node", "time", "iteration", "k"]
    o = obs.select("node", F.col("time").alias("_at"), F.col(variable))
    observed = (fanned(observed_rows).withColumn("_at", shift_hours("time", F.col("offset") * step_hours))
                .join(o, ["node", "_at"]).select(*cols, F.lit("observation").alias("source"), variable))
    if not predicted_rows:
        return observed
    p = predictions.select("node", "time", F.col("iteration").alias("from_iteration"), F.col("k").alias("from_k"), variable)
    predicted = (fanned(predicted_rows).join(p, ["node", "time", "from_iteration", "from_k"])
                 .select(*cols, F.lit("prediction").alias("source"), variable))
    return observed.unionByName(predicted)


def valid_reference_times(available: DataFrame, requested: DataFrame, offsets: Sequence[int]) -> DataFrame:
    """Classify requested reference times: ``ok``, ``duplicate``, ``past``, ``future`` or ``gap``.

    ``available`` has one row per time step of the store; ``offsets`` (hours)
    span the inputs and all targets.
    """
    steps = available.select("time").distinct()
    span = steps.agg(F.struct(F.min("time").alias("first"), F.max("time").alias("last")).alias("_s")).scalar()
    sent = steps.withColumn("_o", F.explode(F.array(*[F.lit(int(h)) for h in sorted(set(offsets))])))
    complete = (sent.select(shift_hours("time", -F.col("_o")).alias("time")).groupBy("time")
                .agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(set(offsets))).drop("_n")
                .withColumn("_complete", F.lit(True)))
    counted = requested.groupBy("time").agg(F.count(F.lit(1)).alias("requests"))
    status = (F.when(shift_hours("time", min(offsets)) < span["first"], "past")
              .when(shift_hours("time", max(offsets)) > span["last"], "future")
              .when(F.col("requests") > 1, "duplicate")
              .when(F.col("_complete").isNull(), "gap").otherwise("ok"))
    return counted.join(complete, "time", "left").select("time", "requests", status.alias("status"))


def sample_vectors(df: DataFrame, features: Sequence[str], output: str = "x") -> DataFrame:
    """Features as one vector per row, in the given order."""
    return df.withColumn(output, F.array(*[F.col(f).cast("double") for f in features])).drop(*features)


def batches(samples: DataFrame, keys: Sequence[str], size: int, seed: int, drop_last: bool = True) -> DataFrame:
    """Seeded shuffle into batches of ``size``; an incomplete last batch may be dropped."""
    numbered = numbered_by_hash(samples, keys, seed)
    out = numbered.withColumn("batch", F.floor(F.col("position") / size).cast("long"))
    if drop_last:
        full = samples.agg((F.floor(F.count(F.lit(1)) / size)).cast("long")).scalar()
        out = out.where(F.col("batch") < full)
    return out


def increment(df: DataFrame, variables: Sequence[str], step_hours: int) -> DataFrame:
    """Difference to the state one step earlier (rows without one are dropped)."""
    both = window_samples(df, variables, [-step_hours, 0])
    return both.select("node", "time", *[F.col(lag_name(v, -step_hours)).alias(f"{v}_last") for v in variables],
                       *[(F.col(lag_name(v, 0)) - F.col(lag_name(v, -step_hours))).alias(v) for v in variables])


def integrate(increments: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Add increments back to the last state."""
    out = increments.withColumns({v: F.col(f"{v}_last") + F.col(v) for v in variables})
    return out.drop(*[f"{v}_last" for v in variables])


# --- user hooks ------------------------------------------------------------------------------

LocalScorer = Callable[[np.ndarray, int], np.ndarray]


def score(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType) -> DataFrame:
    """Run a user model on Arrow batches of rows; ``fn`` sees whatever batch a task holds."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield fn(frame)

    return df.mapInPandas(run, schema)


def with_boundary(df: DataFrame, generator: Callable[[DataFrame], DataFrame],
                  keys: Sequence[str] = ("node", "time")) -> DataFrame:
    """Join boundary conditions a user callable makes for the (node, time) pairs of ``df``; NULL where it makes none."""
    return df.join(generator(df.select(*keys)), list(keys), "left")


def rollout(samples: DataFrame, scorer: LocalScorer, lags: Sequence[str], iterations: int, step_hours: int,
            output: str = "z", block: int | None = None) -> DataFrame:
    """Iterate a node-local scorer, feeding predictions back as the newest lag.

    ``samples`` has (node, time, <lags oldest first>).  ``scorer(state, i)``
    maps an array (rows, lags) to the next value per row.  Nodes do not
    interact, so rows stay in their partition.  ``block`` limits the iterations
    of one pass: the lags carry over through a checkpoint, and Arrow batches stay
    small on long runs.
    """
    block = block or iterations
    keep = samples.select("node", "time", F.array(*[F.col(c).cast("double") for c in lags]).alias("state"))
    schema = T.StructType([keep.schema["node"], keep.schema["time"], T.StructField("iteration", T.IntegerType()),
                           T.StructField(output, T.DoubleType()), T.StructField("state", T.ArrayType(T.DoubleType()))])

    def advance(start: int, stop: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if frame.empty:
                    continue
                state = np.stack(frame["state"].to_numpy())
                for i in range(start, stop):
                    value = np.asarray(scorer(state, i), dtype=float)
                    state = np.column_stack([state[:, 1:], value])
                    carried = list(state) if i == stop - 1 else None
                    yield pd.DataFrame({"node": frame["node"], "time": frame["time"], "iteration": np.int32(i),
                                        output: value, "state": carried})
        return run

    parts = []
    for start in range(0, iterations, block):
        stop = min(start + block, iterations)
        made = keep.mapInPandas(advance(start, stop), schema)
        if stop < iterations:
            made = cut_lineage(made)
            keep = made.where(F.col("iteration") == stop - 1).select("node", "time", "state")
        parts.append(made.drop("state"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("leadtime", ((F.col("iteration") + 1) * step_hours).cast("int"))


StateScorer = Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]


def with_future(samples: DataFrame, boundary: DataFrame, variables: Sequence[str], hours: Sequence[int], output: str = "future") -> DataFrame:
    """Boundary conditions at ``time + h`` for every h of ``hours`` as one struct column of arrays in that order, NULL where there is none.

    Samples and boundary rows meet once in (node, chunk of time), whatever the number of hours; a boundary row travels to the chunks whose
    samples can need it, and the struct travels with its sample from then on.  Of repeated boundary rows the greatest value counts.
    """
    hours = [int(h) for h in hours]
    lo, hi = min(hours), max(hours)
    chunk = max(30 * 24, 8 * (hi - lo))
    keep = [c for c in samples.columns if c not in ("node", "time")]
    own = samples.select("node", "time", F.struct(*keep, F.lit(0).alias("_")).alias("_s"), chunk_index(shift_hours("time", lo), chunk).alias("_chunk"))
    sent = boundary.groupBy("node", "time").agg(F.struct(*[F.max(F.col(v).cast("double")).alias(v) for v in variables]).alias("_b"))
    sent = sent.withColumn("_chunk", F.explode(F.sequence(chunk_index(shift_hours("time", lo - hi), chunk), chunk_index("time", chunk))))
    both = own.unionByName(sent, allowMissingColumns=True).withColumn("_t", epoch_micros("time"))
    order = W.partitionBy("node", "_chunk").orderBy("_t")
    at = [F.max("_b").over(order.rangeBetween(HOUR_US * h, HOUR_US * h)) for h in hours]
    both = both.withColumns({f"_f{i}": c for i, c in enumerate(at)}).where(F.col("_s").isNotNull())
    future = F.struct(*[F.array(*[F.col(f"_f{i}")[v] for i in range(len(hours))]).alias(v) for v in variables])
    return both.select("node", "time", *[F.col("_s")[c].alias(c) for c in keep], future.alias(output))


def rollout_state(samples: DataFrame, scorer: StateScorer, dynamic: Mapping[str, Sequence[str]], iterations: int, step_hours: int, *,
                  boundary: DataFrame | None = None, boundary_vars: Sequence[str] = (), static: DataFrame | None = None, static_vars: Sequence[str] = (),
                  block: int | None = None) -> DataFrame:
    """Iterate a scorer that predicts several variables together from their lags, boundary conditions and static features.

    ``dynamic`` names the lag columns of every variable in ``samples``, oldest first, as many for each.  ``scorer(state, bc, static, i)`` gets
    arrays (rows, lags, variables), (rows, boundary_vars) at the time it predicts (``time + i * step``) and (rows, static_vars), and returns
    (rows, variables), which become the newest lags.  What is missing reaches the scorer as NaN, and NaN comes out as NULL.

    Future boundary values are joined once before the loop and carried with each row, and static features are joined by node, so no step joins
    anything; rows never leave their partition.  ``block`` limits the iterations of one pass, and of the boundary values carried at a time.
    Result: (node, time, iteration, <variables>, leadtime).
    """
    names = list(dynamic)
    lags = {len(dynamic[v]) for v in names}
    if len(lags) != 1 or not names:
        raise ValueError("every variable needs the same number of lags")
    depth, block = lags.pop(), block or iterations
    state = F.array(*[F.col(dynamic[v][k]).cast("double") for k in range(depth) for v in names])
    keep = samples.select("node", "time", state.alias("state"))
    fixed = F.array(*[F.col(c).cast("double") for c in static_vars]) if static_vars else F.array().cast("array<double>")
    keep = keep.join(static.select("node", *static_vars), "node", "left").select(*keep.columns, fixed.alias("static")) if static is not None and static_vars else keep.withColumn("static", fixed)
    schema = T.StructType([keep.schema["node"], keep.schema["time"], T.StructField("iteration", T.IntegerType()), *[T.StructField(v, T.DoubleType()) for v in names],
                           T.StructField("state", T.ArrayType(T.DoubleType())), T.StructField("static", T.ArrayType(T.DoubleType()))])

    def advance(start: int, stop: int):
        def array(column, shape) -> np.ndarray:
            return np.array([[np.nan if x is None else x for x in r] for r in column], dtype=float).reshape(shape)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                n = len(frame)
                if not n:
                    continue
                now, constant = array(frame["state"], (n, depth, len(names))), array(frame["static"], (n, len(static_vars)))
                ahead = np.stack([array([f[v] for f in frame["future"]], (n, stop - start)) for v in boundary_vars], axis=2) if boundary_vars else np.zeros((n, stop - start, 0))
                for i in range(start, stop):
                    value = np.asarray(scorer(now, ahead[:, i - start], constant, i), dtype=float).reshape(n, len(names))
                    now = np.concatenate([now[:, 1:], value[:, None]], axis=1)
                    last = i == stop - 1
                    yield pd.DataFrame({"node": frame["node"], "time": frame["time"], "iteration": np.int32(i), **{v: value[:, k] for k, v in enumerate(names)},
                                        "state": list(now.reshape(n, -1)) if last else None, "static": frame["static"] if last else None})
        return run

    parts = []
    for start in range(0, iterations, block):
        stop = min(start + block, iterations)
        rows = with_future(keep, boundary, boundary_vars, [i * step_hours for i in range(start, stop)]) if boundary is not None and boundary_vars else keep
        made = rows.mapInPandas(advance(start, stop), schema)
        if stop < iterations:
            made = cut_lineage(made)
            keep = made.where(F.col("iteration") == stop - 1).select("node", "time", "state", "static")
        parts.append(made.select("node", "time", "iteration", *[F.when(~F.isnan(v), F.col(v)).alias(v) for v in names]))
    return reduce(DataFrame.unionByName, parts).withColumn("leadtime", ((F.col("iteration") + 1) * step_hours).cast("int"))


def rollout_fields(state: DataFrame, step: Callable[[DataFrame], DataFrame], iterations: int, step_hours: int,
                   block: int = 4) -> DataFrame:
    """Iterate a scorer that mixes nodes: ``step`` maps a (node, time, ...) table to the next one.

    Lineage is cut every ``block`` iterations, so neither the plan nor a lost
    executor costs more than one block.
    """
    parts = []
    for i in range(iterations):
        state = step(state)
        if (i + 1) % block == 0 and i + 1 < iterations:
            state = cut_lineage(state)
        parts.append(state.withColumn("leadtime", F.lit((i + 1) * step_hours)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
