from __future__ import annotations

import json

import pytest

from sparkloom.operators import passages
from sparkloom.sources import corpus

P1, P2, P3 = "The first paragraph speaks of rivers and of mills.", "A second one is about trains, stations and delay.", "The third and last deals with bread, salt and time."


@pytest.fixture
def split(spark):
    def run(text, per_doc=passages.PER_DOC):
        rows = passages.split(spark.createDataFrame([(1, text)], "doc_id long, text string"), per_doc).orderBy("passage_idx").collect()
        return [(r.heading, r.text) for r in rows]

    return run


def test_paragraphs_and_headings(split):
    assert split(f"{P1}\n\n{P2}\n\n{P3}") == [("", P1), ("", P2), ("", P3)]
    assert split(f"# Top\n{P1}\n\n## One\n{P2}\n## Empty\n## Two\n{P3}") == [("Top", P1), ("One", P2), ("Two", P3)]


def test_fragments_are_glued_and_walls_cut(split):
    assert split(f"{P1}\n\nok") == [("", P1 + " ok")]
    assert split(f"short\n\n{P1}") == [("", "short " + P1)]
    wall = " ".join(f"Sentence number {k} has some more words in it." for k in range(60))
    pieces = split(wall)
    assert len(pieces) > 1 and all(len(t) <= passages.TARGET for _, t in pieces) and " ".join(t for _, t in pieces) == wall
    assert len(split("\n\n".join(f"## H{k}\n{P1}" for k in range(200)))) == passages.PER_DOC
    assert split("") == [] and split("tiny") == []


def test_ingest_routes_and_reports(spark):
    trace = "\n".join([json.dumps({"role": "user", "content": P1}), json.dumps({"message": {"role": "assistant", "content": [{"type": "text", "text": P2}, {"type": "tool_use", "name": "Bash", "input": {"x": 1}}]}}), "{bad", json.dumps({"role": "user", "content": "hi"})])
    items = json.dumps([{"label": "L", "text": P1}, {"name": "N", "description": P2, "domain": "My Domain"}, {"text": "x"}])
    key = "password = abcdefgh12345678 and more text to be long enough"
    files = [("notes/a.md", f"# Title\n{P1}\n\n{P2}"), ("t.jsonl", trace), ("i.json", items), ("o.json", '{"a": 1}'), ("tiny.md", "x"), ("bin.exe", "z"), ("k.md", key), ("none.jsonl", "{bad\n{worse")]
    concepts, notes = corpus.ingest(spark.createDataFrame(files, "name string, text string"))
    got = {r.id: r for r in concepts.collect()}
    assert got["notes-a-0"].label == "Title — " + " ".join(P1.split()[:5]) and got["notes-a-0"].domain == "notes" and got["notes-a-0"].text == f"Title. {P1}"
    assert got["t-jsonl-0"].domain == "user" and "used tool Bash" in got["t-jsonl-1"].text
    assert got["i-json-0"].label == "L" and got["i-json-1"].domain == "my-domain" and "i-json-2" not in got
    assert "[REDACTED]" in got["k"].text
    level = {r.file: r.level for r in notes.collect()}
    assert level == {"notes/a.md": "info", "t.jsonl": "warn", "i.json": "warn", "o.json": "error", "tiny.md": "warn", "bin.exe": "info", "k.md": "info", "none.jsonl": "error"}


def test_folder_scan_and_paste(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "node_modules").mkdir()
    for name in ("b.MD", "sub/a.txt", "node_modules/x.md", "c.png"):
        (tmp_path / name).write_text(P1)
    names = [r.name.rsplit("/", 1)[1] for r in corpus.files(spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert names == ["b.MD", "a.txt"]
    assert [(r.id, r.domain) for r in corpus.pasted(spark, f"{P1}\n\n{P2}").collect()] == [("paste-0", "note"), ("paste-1", "note")]
    (tmp_path / "c.json").write_text(json.dumps([{"id": "1", "label": "l", "domain": "d", "text": "t"}]))
    assert corpus.corpus(spark, str(tmp_path / "c.json")).count() == 1


def test_caps(spark):
    docs = spark.createDataFrame([(k, "t") for k in range(9)], "doc_id long, text string")
    assert [r.doc_id for r in passages.first_docs(docs, 5).orderBy("doc_id").collect()] == [0, 1, 2, 3, 4]
    with pytest.raises(Exception, match="at least 4"):
        passages.first_docs(docs.where("doc_id < 2"), 5).collect()
