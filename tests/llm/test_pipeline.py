from __future__ import annotations

import corpus_pipeline
from sparkloom.llm import exact_dedup, langid, packing, pii, simhash
from sparkloom.llm.queries import QUERIES, VOCABULARY


def test_each_stage_is_its_operator_on_what_the_last_one_kept(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        last, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs.select("doc_id").distinct().count())
        if k == 0:
            bad = {r.doc_id for r in langid.identify(last).collect() if r.lang_pred == "und" or r.score < 0.35}
            assert {r.doc_id for r in last.select("doc_id").collect()} - bad == {r.doc_id for r in docs.select("doc_id").collect()}
        if k == 1:
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in exact_dedup.decide(last).where("kept").collect()}
        if k == 2:
            assert {r.doc_id for r in docs.collect()} == {r.component_id for r in simhash.similar_texts(last).collect()}
        if k == 3:
            assert pii.report(docs).selectExpr("sum(n_email + n_ip + n_card + n_phone)").first()[0] == 0
            assert pii.report(last).selectExpr("sum(n_email)").first()[0] > 0
        if k == 4:
            whole = packing.pack(last, VOCABULARY, special=True)
            assert whole.selectExpr("sum(length)").first()[0] == docs.selectExpr("sum(length)").first()[0]
    assert kept == sorted(kept, reverse=True) and kept[0] >= 0.97 * 200 and kept[2] < kept[0]


def test_all_queries_are_registered():
    import __spark_entry__

    assert {"pipeline", *QUERIES} <= set(__spark_entry__.queries())
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11))


def test_all_stages_take_odd_rows_empty_tables_and_further_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row_number int, spans string"
    rows = [(i, " ".join(["the", "thing", "is", f"w{i}"] * 9), "en", "s", 1, 7, "k") for i in range(12)]
    rows += [(None, None, None, None, None, None, None), (20, "", "en", None, 0, 1, ""), (3, rows[3][1], "en", "s", 1, 7, "k"), (None, "Mail me at a.b@c.de, the thing", None, None, 3, 2, "x"), (30, "long " * 20_000, "en", "s", 1, 1, "")]
    full = spark.createDataFrame(rows, schema)
    for name, docs in (("full", full), ("empty", full.where("false"))):
        (tmp_path / name).mkdir()
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path / name))
            assert k == 4 or out.columns == full.columns
            out.write.parquet(str(tmp_path / name / str(k)))
            docs = spark.read.parquet(str(tmp_path / name / str(k)))
        assert (docs.count() > 0) == (name == "full")
