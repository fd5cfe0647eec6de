"""Literals of the domain: numbers, headers, extraction, expressions, scores, ingestion."""

import math

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import fuzzy, numbers, text
from ledgerlens.operators import extraction, grammar, longify, submission
from ledgerlens.sources import reports
from ledgerlens.streaming.ingest import ingest, ingest_counted

NUMBERS = [
    ("1.234.567", 1234567, None), ("(1.234)", -1234, -1.234), ("1.234,5", 1234.5, 1.2345), ("1,5", 1.5, 15), ("1,234", 1234, 1234), ("1,2,3", None, 123),
    ("1.5", 1.5, 1.5), ("-123", None, -123), ("12%", None, None), ("-", None, 0), ("", None, None), ("5.", 5, 5), ("1,234.5", 1.2345, 1234.5), ("12.34.56", 123456, None), ("1234.567.890", 1234567890, None), ("nan", None, math.nan),
]


def test_number_parsers(spark):
    rows = spark.createDataFrame([(s,) for s, *_ in NUMBERS], "s string")
    got = rows.select(numbers.parse_vn_number(F.col("s")).alias("a"), numbers.parse_plain_number(F.col("s")).alias("b")).collect()
    for (s, a, b), r in zip(NUMBERS, got):
        assert r.a == a, s
        assert r.b == b or (b is not None and math.isnan(b) and math.isnan(r.b)), s


YEARS = [("31/12/2015", 2015), ("01/01/2015", 2014), ("Năm 2016", 2016), ("Năm nay", 2018), ("Số cuối năm", 2018), ("Năm trước", 2017), ("Số đầu năm", None),
         ("Số đầu năm 2015", 2015), ("01/01 2015", 2014), ("2018VND", None), ("31/12/1999", None), ("Mã số", None)]


def test_header_years(spark):
    rows = spark.createDataFrame([(s,) for s, _ in YEARS], "s string")
    got = rows.select(longify.header_year(F.col("s"), F.lit(2018)).alias("y"), longify.header_year(F.col("s"), F.lit(2018), True).alias("n")).collect()
    assert [r.y for r in got] == [y for _, y in YEARS]
    assert got[9].n == 2018


def test_text_functions(spark):
    row = spark.createDataFrame([("1. Tổng Tài sản (Đồng) 5%", "Tỷ lệ % của công ty mẹ, đơn vị triệu đồng")], "a string, q string").select(
        text.normalized_text(F.col("a")).alias("n"), text.clean_term(F.col("a")).alias("c"), text.detect_scope(F.col("q")).alias("s"),
        text.target_scale(F.col("q")).alias("u"), text.infer_operation(F.col("q"), F.lit(2), F.lit(1)).alias("o"), text.repair_mojibake(F.lit("Ã©tÃ©")).alias("m"),
    ).first()
    assert tuple(row) == ("1 tong tai san dong 5%", "Tổng Tài sản (Đồng) 5%", "separate", 1e6, "ratio", "été")


def test_fuzzy_scores():
    assert fuzzy.ratio("abc", "abc") == fuzzy.ratio("", "") == 100
    assert round(fuzzy.ratio("abc", "acb"), 2) == 66.67
    assert fuzzy.token_sort_ratio("b a", "a b") == 100 and fuzzy.token_set_ratio("a b", "a b c") == 100 and fuzzy.token_set_ratio("", "a") == 0


HTML = """BÁO CÁO
Đơn vị: triệu đồng
BẢNG CÂN ĐỐI KẾ TOÁN
<table><tr><th>Chỉ tiêu</th><th>Mã số</th><th>31/12/2018</th><th>01/01/2018</th></tr>
<tr><td>Tiền &amp; vàng</td><td>110</td><td>1.234.567</td><td>(1.000)</td></tr>
<tr><td>Hàng tồn kho</td><td>140</td><td>5.000.000</td><td>-</td></tr></table>
<table><tr><td>Mục lục</td><td>Trang</td></tr><tr><td>x</td><td>3</td></tr></table>"""
PLAIN = "Đơn vị: triệu đồng\nBẢNG CÂN ĐỐI KẾ TOÁN\nTiền    100.000    90.000\n\nKẾT QUẢ HOẠT ĐỘNG KINH DOANH\nDoanh thu    603.689\t580.000\n"


def test_extraction_and_longify(spark):
    root = "/d/financial_statements/VNM/2018"
    files = [(f"{root}/a_consolidated_extracted.txt", HTML), (f"{root}/b.txt", PLAIN), (f"{root}/c.txt", None), ("/elsewhere/d.txt", "")]
    tables = extraction.extract_tables(spark.createDataFrame(files, "path string, text string"))
    got = {(r.report_id, r.table_seq): r for r in tables.collect()}
    assert set(got) == {("a_consolidated", 0), ("b", 0), ("b", 1)}
    a = got["a_consolidated", 0]
    assert (a.start_line, a.end_line, a.table_type, a.unit, a.company, a.year, a.is_consolidated) == (2, 5, "CDKT", "Đơn vị: triệu đồng", "VNM", 2018, True)
    assert got["b", 0].is_consolidated is None
    assert [got["b", n].table_type for n in (0, 1)] == ["CDKT", "KQKD"] and got["b", 1].rows == [["Doanh thu", "603.689", "580.000"]]
    facts = {(r.metric_raw, r.year): (r.value, r.unit) for r in longify.longify(tables).collect()}
    assert facts == {("Tiền & vàng", 2018): (1234567.0, "Đơn vị: triệu đồng"), ("Tiền & vàng", 2017): (-1000.0, "Đơn vị: triệu đồng"), ("Hàng tồn kho", 2018): (5e6, "Đơn vị: triệu đồng")}


def test_extraction_rules_of_odd_reports(spark):
    table = lambda *rows: "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"
    assert extraction.parse_table("<table><tr><td>a</td></tr><tr></tr><tr><td> </td><td></td></tr><tr><td>&amp;") == [["a"], ["", ""]]
    money = [["Chỉ tiêu", "x"], ["Tiền", "1.000.000"], ["Nợ", "2.000.000"], ["Vay", "3.000.000"]]
    # a table in one line with more than four cells is no title, whatever it names
    one = table(["Lưu chuyển tiền tệ", "1.000.000", "2.000.000", "3.000.000", "4.000.000"], ["a", "1"])
    kinds = [(x[0], x[2]) for x in extraction.extract(one + "\n" * 3 + table(*money))]
    assert kinds == [(0, "LCTT"), (3, "UNKNOWN")]
    plain = "BẢNG CÂN ĐỐI KẾ TOÁN\n=====\nA  1\nThuyết minh báo cáo\nBẢNG CÂN ĐỐI KẾ TOÁN (tiếp)\nB  2\n\n\n\nC  3\nKẾT QUẢ HOẠT ĐỘNG KINH DOANH\nLƯU CHUYỂN TIỀN TỆ\nĐơn vị: tỷ đồng\nD\t4"
    got = [(x[0], x[1], x[2], x[3], x[5]) for x in extraction.extract(plain)]
    assert got == [
        (0, 7, "CDKT", None, [["A", "1"], ["Thuyết minh báo cáo"], ["BẢNG CÂN ĐỐI KẾ TOÁN (tiếp)"], ["B", "2"]]), (10, 10, "KQKD", None, []),
        (11, 13, "LCTT", None, [["Đơn vị: tỷ đồng"], ["D", "4"]])]
    rows = [("r", 0, 0, 1, "UNKNOWN", None, "A", 2020, None, "", [["Doanh thu bán hàng", "1.000.000"]], "html"), ("r", 1, 0, 1, "UNKNOWN", None, "A", 2020, None, "", [["x"]], "html"),
            ("r", 2, 0, 1, "CDKT", None, "A", 2020, None, "", [["Mục", "Trang"], ["a", "1"]], "html"), ("r", 3, 0, 1, "CDKT", None, "A", 2020, None, "", money, "html")]
    tables = spark.createDataFrame(rows, extraction.SCHEMA)
    assert {r.table_seq: (r.table_type, r.refined) for r in extraction.refine(tables).collect()} == {0: ("KQKD", "heuristic"), 3: ("CDKT", None)}
    said = extraction.verified(tables, lambda prompt: F.lit('ok {"table_type": "LCTT"}')).collect()
    assert [r.table_type for r in said] == ["LCTT", "LCTT", "LCTT", "CDKT"] and extraction.verified(tables) is tables
    scanned = extraction.scan_marks(spark.createDataFrame([("a", "x\nBảng cân đối kế toán\nĐơn vị: triệu"), ("b", None)], "path string, text string")).collect()
    assert (scanned[0].n_lines, scanned[0].hits["CĐKT"], scanned[0].hits["unit"], scanned[0].types, scanned[1].types) == (3, [1], [2], ["CĐKT"], ["UNKNOWN"])
    seen = spark.createDataFrame([("a1 (123) 1 2",), ("sạch",)], "t string").select(extraction.faults(F.col("t"))).collect()
    assert [r[0] for r in seen] == [["số dính chữ", "số âm (123)", "space lạ giữa số"], []]


@pytest.mark.parametrize("title, content, distance, want", [
    (None, "KQKD", 0, "KQKD"), ("THUYET_MINH", "CDKT", 1, "CDKT"), ("CDKT", "LCTT", 1, "LCTT"), ("KQKD", "CDKT", 6, "CDKT"), ("KQKD", "CDKT", 5, "KQKD"),
    ("LCTT", "KQKD", 9, "LCTT"), (None, "UNKNOWN", 0, "UNKNOWN"), ("THUYET_MINH", "UNKNOWN", 3, "THUYET_MINH")])
def test_reconcile(title, content, distance, want):
    assert extraction.reconcile(title, content, distance) == want


def test_grammar(spark):
    rows = [(0, "A", "ACB", 2018, 10.0), (1, "A", "ACB", 2019, 15.0), (2, "B", "VCB", 2018, -4.0), (3, "A", "VCB", 2018, None)]
    df = spark.createDataFrame(rows, "row_id int, canonical string, company string, year int, value double")
    ask = lambda s: grammar.answer(df, s).first().answer
    assert ask("df[(df['canonical']=='A')&(df['năm']==2018)&(df['company']=='ACB')]['giá_trị'].iloc[0]") == 10
    assert ask("(float(df[df['năm']==2019]['giá_trị'].iloc[0]) - float(df[df['năm']==2018]['giá_trị'].iloc[0])) / abs(df[df['năm']==2018]['giá_trị'].iloc[0]) * 100") == 50
    assert ask('float(df1.loc[df1["row_id"].isin([0, 1, 3]),"value"].mean())') == 12.5
    assert ask('int(df1.loc[df1["row_id"].isin([0, 2]),"company"].nunique())') == 2
    assert ask("a = df[df['năm']==2019]['giá_trị'].iloc[0]; b = df[df['năm']==2018]['giá_trị'].iloc[0]; answer = (a / b) ** (1/2) - 1 if b != 0 else None") == pytest.approx(1.5**0.5 - 1)
    assert ask("df['giá_trị'].dropna().iloc[0]") == 10 and ask("0.0") == 0
    for bad in ("__import__('os')", "df.to_csv('x')", "import os", "open('x')"):
        with pytest.raises(ValueError):
            grammar.compile_expression(bad)


def test_submission(spark):
    schema = "id int, answer double, relevant_tables array<string>, pandas_query string, evidence array<struct<variable string, csv_path string>>"
    good = (1, 2.0, ["r|1"], "0.0", [("df1", "data/a.csv")])
    entries = spark.createDataFrame([good, (1, math.nan, [], "import os", [("1x", "data/../b.csv")])], schema)
    found = {r.rule for r in submission.violations(entries, spark.createDataFrame([("data/a.csv",)], "csv_path string"), 3).collect()}
    assert found == {"repeated id", "answer isn't a number", "forbidden statement", "not an identifier", "unsafe path", "file not packed", "wrong number of entries"}
    odd = spark.createDataFrame([(9, 2.0, None, "df['import os']", [("class", "data/a.csv")]), (1, 1.0, [], "x = (", []), (2, math.inf, [], " ", [])], schema)
    rules = {(r.id, r.rule) for r in submission.violations(odd, spark.createDataFrame([("data/a.csv",)], "csv_path string"), 3).collect()}
    assert rules == {(9, "id out of order"), (9, "missing list"), (9, "not an identifier"), (1, "query isn't Python"), (2, "empty query"), (2, "answer isn't a number")}
    one = spark.createDataFrame([good], schema)
    assert tuple(submission.scores(one, one).first()) == (1.0, 1.0, 1.0)
    kinds = spark.createDataFrame([(False, True, 1.0, 1.0), (True, False, 1.0, 1.0), (True, True, 5.0, 5.4), (True, True, 5000.0, 5e6), (True, True, 700.0, 50.0), (None, True, 1.0, 1.0), (True, True, None, 2.0), (True, True, -5e6, 5e3)], "r boolean, e boolean, a double, g double")
    assert [r[0] for r in kinds.select(submission.classify_error(*map(F.col, "reag"))).collect()] == [
        "retrieval_miss", "execution_fail_unrepaired", "ok", "unit_mismatch", "generation_wrong_logic", "retrieval_miss", "generation_wrong_logic", "unit_mismatch"]


def test_sources_and_ingestion(spark, tmp_path):
    (tmp_path / "financial_statements/VNM/2018").mkdir(parents=True)
    (tmp_path / "financial_statements/VNM/2018/a.txt").write_text(HTML, encoding="utf-8")
    (tmp_path / "s.csv").write_text("VNM,Vinamilk\nbad,x\n")
    assert reports.reports(spark, str(tmp_path)).first().text == HTML
    assert {tuple(r) for r in reports.company_aliases(spark, str(tmp_path / "s.csv")).collect()} == {("vnm", "VNM"), ("vinamilk", "VNM")}
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(5).write.parquet(source)
    schema = spark.range(1).schema
    run = lambda: ingest(spark, source, schema, target, str(tmp_path / "ck")).count()
    assert run() == 5 and run() == 5
    spark.range(3).write.mode("append").parquet(source)
    assert run() == 8
    counted = ingest_counted(spark, source, schema, str(tmp_path / "out2"), str(tmp_path / "ck2"), 1)
    assert counted[-1][2] == 8 and sum(n for _, n, _ in counted) == 8 and len(counted) > 1
