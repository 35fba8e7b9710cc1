from __future__ import annotations

import random
import time
from datetime import datetime, timedelta

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.streaming import events as S
from sparkloom.streaming import loop


def test_streams_equal_batch(spark, tmp_path):
    raw = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("name"))
    rows = raw.withColumn("seq", F.row_number().over(W.partitionBy("session").orderBy("ts"))).cache()
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = S.read(spark, str(tmp_path / "in"), "session long, ts timestamp, name string, seq int")
    hours = S.windowed_counts(stream).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    hours.awaitTermination(120)
    want = {(r.w.start, r.name): r.n for r in rows.groupBy(F.window("ts", "1 hour").alias("w"), "name").agg(F.count("*").alias("n")).collect()}
    assert {(r.window_start, r.name): r.n for r in spark.table("hours").collect()} == want
    moves = S.moves(S.read(spark, str(tmp_path / "in"), "session long, ts timestamp, name string, seq int").select("session", "seq", "name"))
    query = moves.writeStream.format("memory").queryName("moves").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    before = F.lag("name").over(W.partitionBy("session").orderBy("seq"))
    batch = rows.withColumn("before", before).where("before is not null").groupBy("before", "name").count().collect()
    got = {(r["before"], r["next"]): r["count"] for r in spark.table("moves").groupBy("before", "next").count().collect()}
    assert got == {(r["before"], r["name"]): r["count"] for r in batch}


def plain_loop(events, card_seconds):
    """One walker's events, one after the other; the view after each."""
    act, recent, focus, thoughts, leaps, card, until, at, seen = {}, [], None, 0, 0, (None, None), None, None, []
    for ts, kind, node, came, weight in events:
        act = {n: v * 0.35 ** ((ts - at).total_seconds()) for n, v in act.items()} if at else act
        at = ts
        if until and until <= at:
            card, until = (None, None), None
        if kind == "neuron":
            thoughts, act[node] = thoughts + 1, 1.0
            if node != focus:
                focus = node
                recent.insert(0, node)
                del recent[6:]
        elif kind == "synapse":
            act[node] = min(1.0, act.get(node, 0.0) + max(0.0, weight) * 0.6)
        else:
            leaps += 1
            act[came] = act[node] = 1.0
            card, until = (came, node), at + timedelta(seconds=card_seconds)
        seen.append((at, focus, list(recent), thoughts, leaps, *card, {n: v for n, v in act.items() if v >= 1e-6}))
    return seen


def test_the_loop_equals_a_plain_one(spark, tmp_path):
    r = random.Random(8)
    start = datetime(2024, 5, 1)
    rows, views = [], {}
    for walker in range(3):
        ts, own = start, []
        for seq in range(90):
            ts += timedelta(milliseconds=r.choice([0, 130, 130, 260, 5000 if seq % 30 == 0 else 130]))
            kind = r.choice(["neuron", "neuron", "synapse", "synapse", "insight" if r.random() < 0.4 else "neuron"])
            own.append((ts, kind, r.randrange(12), r.randrange(12), round(r.uniform(-0.5, 1), 3)))
            rows.append((walker, ts, seq, *own[-1][1:]))
        views[walker] = plain_loop(own, 2.0)
    ddl = "walker long, ts timestamp, seq long, kind string, node long, came_from long, weight double"
    for k in range(3):  # a third of each walker's events at a time, in no order; the last file lets the watermark pass
        part = [x for x in rows if x[2] // 30 == k]
        r.shuffle(part)
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    later = max(x[1] for x in rows) + timedelta(seconds=60)
    spark.createDataFrame([(99, later, 0, "neuron", 1, 1, 0.0), (None, later, 1, "neuron", 1, 1, 0.0), (98, None, 1, "neuron", 1, 1, 0.0)], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", loop.PROVIDER)
    try:
        stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        shown = loop.watch(stream, card_seconds=2.0)
        query = shown.writeStream.format("memory").queryName("shown").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(200)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = [x.asDict() for x in spark.table("shown").collect()]
    for walker, own in views.items():
        mine = [x for x in got if x["walker"] == walker]
        for x, want in zip([x for x in mine if x["thoughts"]][:3], (own[29], own[59], own[89]), strict=True):
            assert (x["at"], x["focus"], x["recent"], x["thoughts"], x["leaps"], x["card_from"], x["card_to"]) == want[:7]
            levels = dict(zip(x["active"], x["level"], strict=True))
            assert set(levels) == set(want[7]) and all(abs(levels[n] - v) < 1e-9 for n, v in want[7].items())
        if own[89][5] is not None:  # the timer took the card away after all
            assert mine[-1]["card_from"] is None and mine[-1]["thoughts"] == own[89][3]
    assert any(v[89][5] is not None for v in views.values()) and {x["walker"] for x in got} == {0, 1, 2, 99}
