"""Corpus documents, dense search, filters and evaluation on small literals."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import keys
from ledgerlens.operators import corpus, evaluation, retrieval

LONG = "report_id string, start_line int, company string, year int, table_type string, unit string, canonical string, metric string, seq int"


def test_table_and_metric_documents(spark):
    rows = [("r", 1, "AAA", 2020, "CDKT", None, "Cash", "Tien", 2), ("r", 1, "AAA", 2020, "CDKT", None, None, "Tien", 1), ("r", 1, "AAA", 2020, "CDKT", None, "", "", 3),
            ("r", 1, "AAA", 2020, "CDKT", None, "Cash", "Tien mat", 4), (None, 1, "B", 2020, None, None, "x", "x", 5)]
    frame = spark.createDataFrame(rows, LONG)
    found = {r.table_key: r.text for r in corpus.table_documents(frame).collect()}
    assert found["r|1"] == "Công ty: AAA | Năm: 2020 | Loại bảng: CDKT | Đơn vị:  | report: r | Tien | Cash | Tien mat"
    texts = sorted(r.text for r in corpus.metric_documents(frame).collect())
    assert texts == ["Công ty AAA ticker AAA năm 2020 CDKT Cash Tien report r", "Công ty AAA ticker AAA năm 2020 CDKT Tien Tien report r"]
    assert corpus.table_documents(frame.limit(0)).count() == 0


def test_expand(spark):
    row = spark.createDataFrame([("q", [["a", "b", "c", "d"], ["e"]], [2020])], "q string, a array<array<string>>, y array<int>")
    assert row.select(corpus.expand(F.col("q"), F.col("a"), F.col("y"))).first()[0] == "q a b c e 2020"


def test_dense_and_filter(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, None)], "doc_id int, vec array<double>")
    queries = spark.createDataFrame([("a", [1.0, 0.5])], "query_id string, vec array<double>")
    found = retrieval.dense(vectors, queries, 3)
    assert [(r.doc_id, r.rank) for r in found.orderBy("rank").collect()] == [(1, 1), (3, 2), (2, 3)]
    meta = spark.createDataFrame([(1, "A", 2019), (2, "A", 2020), (3, "B", 2020)], "doc_id int, company string, year int")
    wanted = spark.createDataFrame([("a", None, 2020)], "query_id string, company string, year int")
    assert [(r.doc_id, r.rank) for r in retrieval.post_filter(found, meta, wanted).orderBy("rank").collect()] == [(3, 1), (2, 2)]


def test_evaluation(spark):
    found = spark.createDataFrame([("a", 1, 1), ("a", 2, 7), ("b", 9, 1)], "query_id string, doc_id int, rank int")
    gold = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("b", "y", 1), ("c", "y", 3)], "query_id string, intent string, doc_id int")
    got = {r.query_id: (r.recall_5, r.recall_10, r.hit) for r in evaluation.retrieval_quality(found, gold).collect()}
    assert got == {"a": (0.5, 1.0, True), "b": (0.0, 0.0, False), "c": (0.0, 0.0, False)}
    configs = spark.createDataFrame([("z", 0.5, 0.7), ("m", 0.7, 0.5), ("k", 0.1, 0.1)], "config string, f2 double, answer_accuracy double")
    assert tuple(evaluation.best_config(configs).first()) == ("m", 0.6)
    assert evaluation.best_config(configs.limit(0)).count() == 0
    row = spark.createDataFrame([(float("nan"), "a\nb\nc\nd", "x", [2019])], "v double, e string, s string, y array<int>")
    out = row.select(evaluation.sane(F.col("v")), evaluation.last_lines(F.col("e")), evaluation.last_lines(F.col("s")), evaluation.year_available(F.col("y"), F.lit(2020))).first()
    assert tuple(out) == (False, "b\nc\nd", "x", False)
    ops = spark.createDataFrame([("df[df['năm']==1].iloc[0]",), (None,)], "q string")
    counts = {r.pattern: r.n for r in evaluation.pattern_counts(ops, "q", evaluation.OPERATION_PATTERNS).collect()}
    assert counts["lookup_simple"] == counts["filter_year"] == 1 and counts["groupby"] == 0


def test_keys(spark):
    one = spark.range(1)
    get = lambda *c: tuple(one.select(*c).first())
    lit = F.lit
    assert get(*(keys.report_year(lit(s)) for s in ("VJC_2018_x", "a20181", "y_1999_2018", None))) == (2018, None, None, None)
    paths = ("a/b\\VJC_2018_extracted.txt", "x/", None, "plain")
    assert get(*(keys.official_report_id(lit(s)) for s in paths)) == ("VJC_2018", "unknown", "unknown", "plain")
    assert get(keys.table_key(lit("r"), lit(3)), keys.table_key(lit("r"), lit(None)), keys.table_key(lit(None), lit(3))) == ("r|3", "r", "unknown|3")
    assert get(keys.code_block(lit("so:\n```python\nx = 1\n```\nend")), keys.code_block(lit(" y "))) == ("x = 1", "y")
    assert get(*(keys.eval_query(lit(s)) for s in ("answer = df.x", "answer=1", " ", None, "f(2)"))) == ("df.x", "1", "0.0", "0.0", "f(2)")
    assert get(keys.unit_answer(lit(2.0), lit("Tỷ đồng"), lit("triệu đồng")), keys.unit_answer(lit(2.0), lit(None), lit("tỷ đồng"))) == (2000.0, 2.0)


def test_verify(spark):
    rows = spark.createDataFrame([(100.0, "calc_ratio"), (900.0, "calc_ratio"), (900.0, "lookup"), (None, "calc_ratio"), (float("nan"), None)], "a double, i string")
    got = [(r.v.valid, len(r.v.issues)) for r in rows.select(evaluation.verify(F.col("a"), F.col("i")).alias("v")).collect()]
    assert got[:4] == [(True, 0), (False, 1), (True, 0), (False, 1)] and not got[4][0]
    gold = spark.createDataFrame([("notes_qa", "1.5"), ("thuyet_minh", "x"), ("other", "2")], "category string, answer string")
    assert tuple(evaluation.notes_format(gold).first()) == (2, 0.5)
    assert tuple(evaluation.notes_format(gold.limit(0)).first()) == (0, None)


def test_extraction_report_misses_and_blocks(spark, monkeypatch):
    from ledgerlens.operators import ontology

    reports = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "report_id string")
    tables = spark.createDataFrame([("a", "CDKT", "VND", "X"), ("a", "UNKNOWN", None, "X"), ("b", "THUYET_MINH", "", "Y"), ("a", "KQKD", "x", "X")], "report_id string, table_type string, unit string, company string")
    r = evaluation.extraction_report(reports, tables).first()
    assert (r.total_files, r.files_with_tables, r.files_with_main, r.n_tables, r.n_main, r.n_with_unit, r.companies, r.n_unknown, r.least, r.p50, r.p90, r.most) == (3, 2, 1, 4, 2, 2, 2, 1, 1, 1, 3, 3)
    assert r.coverage == pytest.approx(2 / 3) and r.main_coverage == pytest.approx(1 / 3)
    gold = spark.createDataFrame([("q", "i", 1), ("r", "i", 2)], "query_id string, intent string, doc_id int")
    found = spark.createDataFrame([("q", 1, 3), ("r", 2, 25)], "query_id string, doc_id int, rank int")
    assert [m.query_id for m in evaluation.misses(found, gold).collect()] == ["r"]
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2), monkeypatch.setattr(ontology, "ALIAS_BLOCK", 2)
    vectors = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(6)], "doc_id int, vec array<double>")
    asked = spark.createDataFrame([(k, [1.0, float(-k)]) for k in range(5)], "query_id int, vec array<double>")
    got = retrieval.dense(vectors, asked, 1).collect()
    assert sorted((g.query_id, g.doc_id) for g in got) == [(k, 5) for k in range(5)]
    index = ontology.alias_index(spark.createDataFrame([(f"alias number {c}", c, 0) for c in "abcdef"], "alias string, canonical string, seq int"))
    mapped = ontology.map_terms(spark.createDataFrame([("number e alias x",), ("zzz",)], "raw string"), index)
    assert {m.raw: m.canonical for m in mapped.collect()} == {"number e alias x": "e", "zzz": None}
