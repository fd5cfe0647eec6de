"""Labels and aliases of any length and number."""

import pytest

from ledgerlens import queries
from ledgerlens.plans import questions

FACTS = "metric string, canonical string, company string, year int, value double, unit string, is_consolidated boolean, report_id string, start_line int"


def test_labels_of_more_than_twelve_words_are_found(spark):
    label = "Bình quân gia quyền của số cổ phiếu phổ thông đang lưu hành dùng để tính lãi cơ bản trên cổ phiếu"
    facts = spark.createDataFrame([(label, None, "AAA", 2020, 7.0, "VND", False, "r", 1), ("Cổ phiếu", None, "AAA", 2020, 9.0, "VND", False, "r", 2)], FACTS)
    asked = spark.createDataFrame([(1, f"{label} của AAA năm 2020?")], "question_id int, question string")
    aliases = spark.createDataFrame([("aaa", "AAA")], "alias string, ticker string")
    assert questions.answer_questions(facts, asked, aliases).first().answer == pytest.approx(7.0)


def test_every_part_type_is_an_alias(spark, tmp_path):
    types = [f"KIND {a}{b}" for a in "QWERTY" for b in "ASDFG"]
    spark.createDataFrame([(t,) for t in types], "p_type string").write.parquet(str(tmp_path / "part.parquet"))
    got = {r.raw: (r.canonical, r.confidence) for r in queries.fuzzy_ontology_join(spark, str(tmp_path)).collect()}
    assert got == {t.lower(): (t.lower(), 100.0) for t in types}
