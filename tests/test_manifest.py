from __future__ import annotations

import threading

import pytest

from sparkloom.sources import sinks
from sparkloom.sources.manifest import Contended, Entry, Manifest


def test_interleaved_writers_lose_nothing(spark, tmp_path):
    a, b = Manifest(spark, str(tmp_path)), Manifest(spark, str(tmp_path))
    assert a.version() == 0 and a.entries() == []
    a.put(Entry("one", "One", "/p/1"))
    tries = []

    def late(held):
        """While a works out its change, b commits another."""
        tries.append(sorted(held))
        if len(tries) == 1:
            b.put(Entry("two", "Two", "/p/2"))
        return held | {"three": Entry("three", "Three", "/p/3", 7, 9)}

    assert a.change(late) == 3 and tries == [["one"], ["one", "two"]]
    assert [e.name for e in b.entries()] == ["one", "three", "two"] and [e.name for e in b.entries(1)] == ["one"]
    a.put(Entry("one", "Uno", "/p/1b"))
    b.remove("two", "absent")
    assert [(e.name, e.label) for e in a.entries()] == [("one", "Uno"), ("three", "Three")]


def test_many_writers_at_once(spark, tmp_path):
    threads = [threading.Thread(target=lambda k=k: [Manifest(spark, str(tmp_path)).put(Entry(f"g{k}-{i}", "", "")) for i in range(5)]) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    m = Manifest(spark, str(tmp_path))
    assert {e.name for e in m.entries()} == {f"g{k}-{i}" for k in range(4) for i in range(5)}


def test_a_writer_gives_up_in_the_end(spark, tmp_path):
    a, b = Manifest(spark, str(tmp_path)), Manifest(spark, str(tmp_path))
    with pytest.raises(Contended):
        a.change(lambda held: b.put(Entry("x", str(b.version()), "")) and held)


def test_the_last_entry_may_go(spark, tmp_path):
    m = Manifest(spark, str(tmp_path))
    m.put(Entry("only", "", ""))
    m.remove("only")
    assert m.entries() == [] and m.version() == 2


def test_graphs_are_loaded_by_name_or_default(spark, tmp_path):
    m = Manifest(spark, str(tmp_path))
    for k, name in enumerate(("safe", "mine")):
        df = spark.createDataFrame([(k,)], "i long")
        sinks.write_graph(str(tmp_path / name), df, df, df, df)
        m.put(Entry(name, name.title(), str(tmp_path / name), 1))
        if not k:
            assert m.find().name == "safe"
    assert m.load("mine")["neurons"].first().i == 1 and m.load(default="safe")["meta"].first().i == 0 and set(m.load("mine", "safe")) == {"neurons", "synapses", "insights", "meta"}
    for bad in ({"name": "none"}, {}, {"default": "gone"}):
        with pytest.raises(LookupError):
            m.load(**bad)
