"""The live walk over the graph: attention follows strong, little visited synapses or jumps; what fires spreads to its
neighbours; and now and then a dream lights up both ends of a bridge, which moves neither attention nor counts of visits.

Walkers are rows, and a superstep moves all of them at once: each meets the row of the node that it attends to, which holds
the node's neighbours in order, fires, and chooses where to go. Nodes stand in a table bucketed by number, so that walkers
move and the graph doesn't; a walker carries the nodes that it has visited and those that are still active, not the graph.
Supersteps are written to the shared folder, from where the next one reads them. Everything is built-in expressions.

Draws are hashes of (seed, walker, step, purpose): a walk can be repeated, and no draw depends on another. To choose a neighbour
means to read all of a node's weights, since novelty changes them by walker; firing its synapses reads them anyway.

An activation below ``FAINT`` is forgotten, which it is some hundred steps after its last touch. A graph without edges has no
walk; an edge from a node to itself is followed like any other.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..staging import scratch_path, stage

# Chances of following a synapse and of a dream, spread, decay a second, nodes sampled for a jump, seconds a step.
FOLLOW, DREAM, GAIN, DECAY, SAMPLES, STEP_SECONDS = 0.72, 0.13, 0.6, 0.35, 6, 0.13
FAINT = 1e-6
#: What a draw is for; a jump takes ``SAMPLES + 1`` draws from ``_JUMP`` on.
_FOLLOW, _PICK, _DREAM, _WHICH, _JUMP = 0, 1, 2, 3, 4

_EVENT = "struct<kind:string,node:bigint,came_from:bigint,weight:double>"
_STATE = f"walker long, step int, focus long, came_from long, weight double, visits map<bigint,bigint>, act map<bigint,double>, fired array<{_EVENT}>"


def draw(seed: int, walker: Column, step: Column, purpose: int) -> Column:
    """A number from 0 to below 1."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), walker.cast("long"), step.cast("int"), F.lit(purpose)), 11) * F.lit(2.0**-53)


def numbered(ids: DataFrame) -> tuple[DataFrame, int]:
    """(id, node): distinct ids with their places in rising order from 0, and how many there are. No task sees all of them."""
    placed = stage(ids.distinct().repartitionByRange("id").sortWithinPartitions("id").withColumn("at", F.monotonically_increasing_id()), "walk-ids")
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    out = placed.withColumn("part", part).join(F.broadcast(before), "part").select("id", (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("node"))
    return out, placed.count()


def pick(scores: Column, u: Column) -> Column:
    """The place, from 0, that ``u`` falls on when each place has a share in proportion to its score; equal shares if none is above 0."""
    positive = F.transform(scores, lambda x: F.greatest(x, F.lit(0.0)))
    total = F.aggregate(positive, F.lit(0.0), lambda s, x: s + x)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
    step = lambda s, x: F.struct((s["sum"] + x).alias("sum"), (s["n"] + F.when(s["sum"] + x <= u * total, 1).otherwise(0)).alias("n"))
    passed = F.aggregate(positive, start, step, lambda s: s["n"])
    return F.least(F.when(total > 0, passed).otherwise(F.floor(u * F.size(scores)).cast("int")), F.size(scores) - 1)


def _seen(node: Column) -> Column:
    return F.coalesce(F.try_element_at("visits", node), F.lit(0).cast("long"))


def _lit_up(act: Column, nodes: Column) -> Column:
    """``act`` with ``nodes`` fully active."""
    full = F.map_from_arrays(nodes, F.transform(nodes, lambda _: F.lit(1.0)))
    return F.map_zip_with(act, full, lambda _, a, b: F.coalesce(b, a))


def _superstep(state: DataFrame, nodes: DataFrame, far: DataFrame, n: int, n_far: int, first: bool, last: bool, seed: int) -> DataFrame:
    """What the step that led here fires (nothing at first), and where attention goes next. The same plan for every step."""
    on = state.join(nodes, state["focus"] == nodes["node"])
    u = lambda purpose, at: draw(seed, F.col("walker"), at, purpose)
    if not first:
        if n_far:
            dreaming = F.when(u(_DREAM, F.col("step")) < DREAM, F.floor(u(_WHICH, F.col("step")) * n_far))
            on = on.withColumn("place", dreaming).join(far, "place", "left")
        else:
            on = on.select("*", *(F.lit(None).cast(k).alias(c) for c, k in (("s", "long"), ("t", "long"), ("fs", "long"), ("ft", "long"), ("fw", "double"))))
        event = lambda kind, node, came, w: F.struct(F.lit(kind).alias("kind"), node.alias("node"), came.alias("came_from"), w.alias("weight"))
        fired = F.concat(
            F.array(event("neuron", F.col("id"), F.col("came_from"), F.col("weight"))), F.transform("near", lambda x: event("synapse", x["id"], F.col("id"), x["w"])),
            F.when(F.col("fw").isNotNull(), F.array(event("insight", F.col("t"), F.col("s"), F.col("fw")))).otherwise(F.array().cast(f"array<{_EVENT}>")),
        )
        faded = F.map_filter(F.transform_values("act", lambda _, v: v * DECAY**STEP_SECONDS), lambda _, v: v >= FAINT)
        gains = F.map_from_arrays(F.transform("near", lambda x: x["node"]), F.transform("near", lambda x: F.greatest(x["w"], F.lit(0.0)) * GAIN))
        spread = F.map_zip_with(_lit_up(faded, F.array("focus")), gains, lambda _, a, g: F.least(F.lit(1.0), F.coalesce(a, F.lit(0.0)) + F.coalesce(g, F.lit(0.0))))
        act = F.when(F.col("fw").isNotNull(), _lit_up(spread, F.array_distinct(F.array("fs", "ft")))).otherwise(spread)
        on = on.withColumn("fired", fired).withColumn("act", act)
    if last:
        return on.select("walker", "step", "focus", "came_from", "weight", "visits", "act", "fired")
    after = F.col("step") + 1
    scores = F.transform("near", lambda x: F.greatest(x["w"], F.lit(0.0)) / (1 + _seen(x["node"])))
    chosen = F.when((F.size("near") > 0) & (u(_FOLLOW, after) < FOLLOW), F.get("near", pick(scores, u(_PICK, after))))
    asked = F.array(*(F.struct(_seen(c).alias("seen"), F.lit(k).alias("turn"), c.alias("node")) for k in range(SAMPLES + 1) for c in [F.floor(u(_JUMP + k, after) * n)]))
    on = on.withColumn("chosen", chosen).withColumn("next", F.coalesce(F.col("chosen.node"), F.array_min(asked)["node"]))
    visits = F.map_concat(F.map_filter("visits", lambda k, _: k != F.col("next")), F.create_map("next", _seen(F.col("next")) + 1))
    return on.select("walker", "step", F.col("next").alias("focus"), F.col("id").alias("came_from"), F.coalesce("chosen.w", F.lit(0.0)).alias("weight"), visits.alias("visits"), "act", "fired")


def supersteps(edges: DataFrame, walkers: int, steps: int, seed: int = 7) -> DataFrame:
    """A row for each walker and step: what fired, and the walker's state after it. ``focus`` and the keys of ``act`` and
    ``visits`` are places of ids in rising order; ``focus`` and ``visits`` are those of the step to come, in the last row its own.
    """
    spark = edges.sparkSession
    edges = stage(edges.select(F.col("s").cast("long").alias("s"), F.col("t").cast("long").alias("t"), F.col("w").cast("double").alias("w"), "is_long"), "walk-edges")
    ids, n = numbered(edges.select(F.col("s").alias("id")).union(edges.select("t")))
    if not n or not steps or not walkers:
        return spark.createDataFrame([], _STATE).withColumn("step", F.col("step").cast("long"))
    ids = stage(ids, "walk-nodes")
    ends = edges.join(ids.toDF("s", "fs"), "s").join(ids.toDF("t", "ft"), "t")
    far = ends.where("is_long").select(F.struct("s", "t").alias("id"), "s", "t", "fs", "ft", F.col("w").alias("fw"))
    places, n_far = numbered(far.select("id"))
    far = stage(far.join(places, "id").select(F.col("node").alias("place"), "s", "t", "fs", "ft", "fw"), "walk-far")
    both = ends.select(F.col("fs").alias("node"), F.col("s").alias("id"), F.col("ft").alias("other"), F.col("t").alias("other_id"), "w")
    both = both.union(ends.select("ft", "t", "fs", "s", "w"))
    near = F.sort_array(F.collect_list(F.struct(F.col("other").alias("node"), F.col("other_id").alias("id"), "w"))).alias("near")
    table, root = f"sparkloom_walk_{uuid.uuid4().hex}", scratch_path(spark, "walk")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        both.groupBy("node", "id").agg(near).write.bucketBy(buckets, "node").option("path", f"{root}/graph").saveAsTable(table)
        nodes = spark.table(table)
        first = F.floor(draw(seed, F.col("id"), F.lit(-1), _JUMP) * n)
        empty = {"came_from": "long", "weight": "double", "visits": "map<bigint,bigint>", "act": "map<bigint,double>", "fired": f"array<{_EVENT}>"}
        state = spark.range(walkers).select(F.col("id").alias("walker"), F.lit(-1).alias("step"), first.alias("focus"), *((F.create_map() if k.startswith("map") else F.lit(None)).cast(k).alias(c) for c, k in empty.items()))
        for step in range(-1, steps):
            path = f"{root}/walked/step{step}"
            _superstep(state, nodes, far, n, n_far, step < 0, step == steps - 1, seed).write.parquet(path)
            state = spark.read.schema(_STATE).parquet(path).withColumn("step", F.col("step") + 1)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    return spark.read.schema(_STATE).option("recursiveFileLookup", "true").parquet(f"{root}/walked").where("step >= 0").withColumn("step", F.col("step").cast("long"))


def walk(edges: DataFrame, walkers: int, steps: int, seed: int = 7) -> DataFrame:
    """walker, step, kind (neuron, synapse, insight), node, came_from, weight. ``edges(s, t, w, is_long)``; ids are the edges'.

    A neuron comes from the one attended to before; its weight is that of the synapse followed, or 0 after a jump. An insight
    goes from the edge's ``s`` to its ``t``.
    """
    return supersteps(edges, walkers, steps, seed).select("walker", "step", F.inline("fired"))
