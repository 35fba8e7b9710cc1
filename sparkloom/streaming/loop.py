"""The live loop over a stream of what walkers fire: attention, the last nodes attended to, activation, and the card on show.

Each walker's state is its own: a value (where attention is, counts, the card), a list of the recent nodes, and a map of what
is active, where an entry says how high it was and when. Activation falls with the time that has passed, which is worked out
where an entry is read, so that a step touches the nodes it fires and no others. A card goes when its time is up, by a timer on
event time; nothing needs to arrive for that but the watermark.

Events of a walker are taken in order of time and ``seq`` within a batch; one that comes behind later ones counts as if it had
come at the last time seen. Events without a walker or a time are left out. Needs the RocksDB state store, which the session
names in ``spark.sql.streaming.stateStore.providerClass``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.walk import DECAY, FAINT, GAIN
from ..shipping import ship

# Fixed value: how many recent nodes are kept. How long a card stays is a parameter.
RECENT = 6
CARD_SECONDS = 9.0
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SHOWN = "walker long, at timestamp, focus long, recent array<long>, thoughts long, leaps long, card_from long, card_to long, active array<long>, level array<double>"
_NOW = "at long, focus long, thoughts long, leaps long, card_from long, card_to long, card_until long"


def faded(level: float, since: int, now: int) -> float:
    """What is left of ``level`` after the time from ``since`` to ``now``, in microseconds."""
    return level * DECAY ** ((now - since) / 1e6)


class Loop(StatefulProcessor):
    """One walker's view; ``card_seconds`` is how long a card stays."""

    def __init__(self, card_seconds: float = CARD_SECONDS):
        self.card = int(card_seconds * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", _NOW)
        self.recent = handle.getListState("recent", "node long")
        self.act = handle.getMapState("act", "node long", "level double, since long")

    def _level(self, node: int, at: int) -> float:
        held = self.act.getValue((node,)) if self.act.containsKey((node,)) else None
        return faded(held[0], held[1], at) if held else 0.0

    def _show(self, walker: int, now: tuple, recent: list[int]) -> pd.DataFrame:
        at = now[0]
        levels = {int(k[0]): faded(v[0], v[1], at) for k, v in self.act.iterator()}
        for node in [n for n, v in levels.items() if v < FAINT]:
            self.act.removeKey((node,))
        active = sorted(n for n, v in levels.items() if v >= FAINT)
        row = [walker, pd.Timestamp(at, unit="us"), now[1], recent, now[2], now[3], now[4], now[5], active, [levels[n] for n in active]]
        out = pd.DataFrame([row], columns=[c.split()[0] for c in SHOWN.split(", ")])
        return out.astype({c: "Int64" for c in ("focus", "card_from", "card_to")})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, focus, thoughts, leaps, card_from, card_to, until = self.now.get() if self.now.exists() else (0, None, 0, 0, None, None, None)
        recent = [int(r[0]) for r in self.recent.get()] if self.recent.exists() else []
        batch = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")
        before = until
        for ts, kind, node, came, weight in zip(batch["ts"], batch["kind"], batch["node"], batch["came_from"], batch["weight"], strict=True):
            at = max(at, pd.Timestamp(ts).value // 1000)
            if until is not None and until <= at:
                card_from = card_to = until = None
            node = int(node)
            if kind == "neuron":
                thoughts += 1
                self.act.updateValue((node,), (1.0, at))
                if node != focus:
                    focus, recent = node, [node, *recent][:RECENT]
            elif kind == "synapse":
                self.act.updateValue((node,), (min(1.0, self._level(node, at) + max(0.0, float(weight)) * GAIN), at))
            elif kind == "insight":
                leaps += 1
                for end in (int(came), node):
                    self.act.updateValue((end,), (1.0, at))
                card_from, card_to, until = int(came), node, at + self.card
        if until != before:
            if before is not None:
                self.handle.deleteTimer(before // 1000)
            if until is not None:
                self.handle.registerTimer(until // 1000)
        now = (at, focus, thoughts, leaps, card_from, card_to, until)
        self.now.update(now)
        self.recent.put([(n,) for n in recent])
        yield self._show(key[0], now, recent)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, focus, thoughts, leaps, _, _, until = self.now.get()
        now = (max(at, until or at), focus, thoughts, leaps, None, None, None)
        self.now.update(now)
        yield self._show(key[0], now, [int(r[0]) for r in self.recent.get()])

    def close(self) -> None:
        pass


def watch(events: DataFrame, late: str = "1 second", card_seconds: float = CARD_SECONDS) -> DataFrame:
    """What to show of each walker that something happened to, a row a batch (see ``SHOWN``).

    ``events`` is a stream of (walker, ts, seq, kind, node, came_from, weight), as ``walk.walk`` gives them with a time.
    """
    ship(events.sparkSession)
    some = events.where("walker is not null and ts is not null and node is not null").withWatermark("ts", late)
    rows = some.select("walker", "ts", "seq", "kind", "node", F.coalesce("came_from", "node").alias("came_from"), F.coalesce("weight", F.lit(0.0)).alias("weight"))
    return rows.groupBy("walker").transformWithStateInPandas(Loop(card_seconds), SHOWN, "Update", "EventTime")
