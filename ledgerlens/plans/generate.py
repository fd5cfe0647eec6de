"""Question generators (inventory Y1-Y15, N25, N26, O10, W8): a relational query and a template each; random choices by hash order.

Facts are (company, year, metric, value) with one row of a key; ``mapped`` makes
them. A sample has category, question, pandas_query, answer and the companies,
years and metrics of its evidence.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.numbers import answer_match
from ledgerlens.operators.dedupe import first_of_near
from ledgerlens.plans import facts as P
from ledgerlens.sources.staging import staged

#: A figure under this is no amount of money; in notes under the second.
LEAST, LEAST_NOTES = 1000.0, 100.0
SAMPLE = ["category", "question", "pandas_query", "answer", "companies", "years", "metrics"]
#: Kinds of two-metric questions with their categories and templates (first metric, second metric, company, year).
PAIRS = {
    "ratio": ("ratio_structure", "%1$s chiếm bao nhiêu phần trăm %2$s của %3$s năm %4$d?"),
    "index": ("financial_index", "Tỷ suất %1$s trên %2$s của %3$s năm %4$d là bao nhiêu (đơn vị phần trăm)?"),
    "turnover": ("multi_table", "Vòng quay %1$s trên %2$s của %3$s năm %4$d là bao nhiêu?"),
    "sum": ("sum_two", "Tổng %1$s và %2$s của %3$s năm %4$d là bao nhiêu?"),
    "difference": ("multi_table", "%1$s trừ %2$s của %3$s năm %4$d là bao nhiêu?"),
}


def _pick(key: list[str], seed: int) -> Column:
    return F.xxhash64(*key, F.lit(seed))


def _value(**by: Column) -> Column:
    """The expression of the first value of an evidence frame by canonical, year or company."""
    names = {"metric": "canonical", "year": "năm", "company": "company"}
    tests = [F.concat(F.lit(f"(df['{names[k]}']=="), v if k == "year" else F.concat(F.lit("'"), v, F.lit("'")), F.lit(")")) for k, v in by.items()]
    both = tests[0] if len(tests) == 1 else reduce(lambda a, b: F.concat(a, F.lit(" & "), b), tests)
    return F.concat(F.lit("float(df["), both, F.lit("]['giá_trị'].iloc[0])"))


def _sample(rows: DataFrame, category: str | Column, question: Column, query: Column, answer: Column, companies: list[Column], years: list[Column], metrics: list[Column]) -> DataFrame:
    category = F.lit(category) if isinstance(category, str) else category
    return rows.select(
        category.alias("category"), question.alias("question"), query.alias("pandas_query"), answer.cast("double").alias("answer"),
        F.array(*companies).alias("companies"), F.array(*years).alias("years"), F.array(*metrics).alias("metrics"),
    )


def mapped(facts: DataFrame, core: list[str] | None = None) -> DataFrame:
    """Of rows (company, year, canonical, value, is_consolidated, report_id) with all keys, and of the core metrics if named, the largest by absolute value of each (company, year, metric)."""
    rows = facts.where("company is not null and year is not null and canonical is not null and value is not null")
    rows = rows if core is None else rows.where(F.col("canonical").isin(core))
    best = F.min(F.struct((-F.abs("value")).alias("k"), "report_id", "value"))
    found = rows.groupBy("company", "year", F.col("canonical").alias("metric")).agg(best.alias("b"))
    return found.select("company", "year", "metric", "b.value", "b.report_id")


C, Y, M = (lambda: F.col("company")), (lambda: F.col("year")), (lambda: F.col("metric"))  # columns need a session


def _one(facts: DataFrame, category: str, template: str, wrap: Callable[[Column], Column], answer: Column) -> DataFrame:
    """A question about one value; the template takes metric, company, year."""
    return _sample(facts, category, F.format_string(template, M(), C(), Y()), wrap(_value(metric=M(), year=Y(), company=C())), answer, [C()], [Y()], [M()])


def lookup(facts: DataFrame, category: str = "lookup_simple", least: float = LEAST) -> DataFrame:
    """Y1, Y8."""
    return _one(facts.where(F.abs("value") >= least), category, "%s của %s năm %d là bao nhiêu?", lambda v: v, F.col("value"))


def notes(facts: DataFrame) -> DataFrame:
    """Y5, Y8."""
    return _one(facts.where(F.abs("value") >= LEAST_NOTES), "notes_qa", "Theo thuyết minh / chi tiết BCTC, %s của %s năm %d là bao nhiêu?", lambda v: v, F.col("value"))


def unit_round(facts: DataFrame) -> DataFrame:
    """Billions to one place, half to even."""
    round_ = lambda v: F.concat(F.lit("round("), v, F.lit(" / 1e9, 1)"))
    return _one(facts.where(F.abs("value") >= LEAST), "unit_rounding", "%s của %s năm %d là bao nhiêu tỷ đồng (làm tròn 1 chữ số)?", round_, F.bround(F.col("value") / 1e9, 1))


def negative(facts: DataFrame) -> DataFrame:
    """Y8."""
    return _one(facts.where("value < 0"), "negative_value", "%s của %s năm %d có âm không, giá trị là bao nhiêu?", lambda v: v, F.col("value"))


def _lag(facts: DataFrame, back: int, category: str, template: str, query: Callable[[Column, Column], Column], answer: Column) -> DataFrame:
    """A question about a value and that of ``back`` years before; the template takes metric, company, year, earlier year."""
    now, then = _value(year=Y()), _value(year=Y() - back)
    return _sample(facts, category, F.format_string(template, M(), C(), Y(), Y() - back), query(now, then), answer, [C()], [Y() - back, Y()], [M()])


def compare_years(facts: DataFrame) -> DataFrame:
    """Percent change on the year before."""
    change = lambda a, b: F.concat(F.lit("("), a, F.lit(" - "), b, F.lit(") / abs("), b, F.lit(") * 100"))
    return _lag(P.lagged(facts, 1).where("before <> 0"), 1, "compare_2years", "%1$s của %2$s tăng bao nhiêu phần trăm từ năm %4$d sang năm %3$d?", change, (F.col("value") - F.col("before")) / F.abs("before") * 100)


def year_difference(facts: DataFrame, least: float = 0.0) -> DataFrame:
    """The absolute change on the year before."""
    change = lambda a, b: F.concat(a, F.lit(" - "), b)
    rows = P.lagged(facts.where(F.abs("value") >= least), 1)
    return _lag(rows, 1, "yoy_abs_diff", "%s của %s năm %d tăng/giảm bao nhiêu so với năm %d?", change, F.col("value") - F.col("before"))


def growth(facts: DataFrame) -> DataFrame:
    """Compound growth over two years, from a positive start."""
    root = lambda a, b: F.concat(F.lit("("), a, F.lit(" / "), b, F.lit(") ** (1/2) - 1"))
    rows = P.lagged(facts, 2).where("before > 0 and value >= 0")
    return _lag(rows, 2, "cagr", "CAGR %1$s của %2$s giai đoạn %4$d-%3$d là bao nhiêu?", root, F.pow(F.col("value") / F.col("before"), 0.5) - 1)


def combine(facts: DataFrame, pairs: list[tuple[str, str]], kind: str = "ratio", seed: int = 42) -> DataFrame:
    """For each (company, year) one of the pairs, by hash; kinds of PAIRS. Denominators under 1 are left out."""
    both = facts.groupBy("company", "year").pivot("metric", sorted({m for p in pairs for m in p})).agg(F.max("value"))
    n = F.pmod(_pick(["company", "year"], seed), F.lit(len(pairs)))
    category, template = PAIRS[kind]
    out = []
    for k, (a, b) in enumerate(pairs):
        x, y = F.col(f"`{a}`"), F.col(f"`{b}`")
        rows = both.where((n == k) & x.isNotNull() & y.isNotNull())
        rows = rows if kind in ("sum", "difference") else rows.where(F.abs(y) >= 1)
        va, vb = _value(metric=F.lit(a)), _value(metric=F.lit(b))
        sign, answer, tail = {"sum": (" + ", x + y, ""), "difference": (" - ", x - y, ""), "turnover": (" / ", x / y, "")}.get(kind, (" / ", x / y * 100, " * 100"))
        question = F.format_string(template, F.lit(a), F.lit(b), C(), Y())
        out.append(_sample(rows, category, question, F.concat(va, F.lit(sign), vb, F.lit(tail)), answer, [C()], [Y()], [F.lit(a), F.lit(b)]))
    return reduce(DataFrame.unionByName, out)


def _two_companies(rows: DataFrame, template: str) -> DataFrame:
    a, b = F.col("company1"), F.col("company2")
    query = F.concat(_value(company=a), F.lit(" - "), _value(company=b))
    question = F.format_string(template, M(), Y(), a, b)
    return _sample(rows, "compare_companies", question, query, F.col("value1") - F.col("value2"), [a, b], [Y()], [M()])


def compare_companies(facts: DataFrame, seed: int = 42) -> DataFrame:
    """The two companies with the least hash of each (year, metric)."""
    w = Window.partitionBy("year", "metric").orderBy(_pick(["company"], seed), "company")
    two = facts.withColumn("r", F.row_number().over(w)).where("r <= 2").groupBy("year", "metric").agg(
        *(F.max(F.when(F.col("r") == k, F.col(x))).alias(f"{x}{k}") for k in (1, 2) for x in ("company", "value"))
    ).where("company2 is not null")
    return _two_companies(two, "Chênh lệch %1$s giữa %3$s và %4$s năm %2$d (%3$s trừ %4$s) là bao nhiêu?")


def compare_neighbours(facts: DataFrame, least: float = LEAST) -> DataFrame:
    """Each company with the next one by name of each (year, metric)."""
    w = Window.partitionBy("year", "metric").orderBy("company")
    rows = facts.where(F.abs("value") >= least).select(
        "year", "metric", F.col("company").alias("company1"), F.col("value").alias("value1"), F.lead("company").over(w).alias("company2"), F.lead("value").over(w).alias("value2")
    ).where("company2 is not null")
    return _two_companies(rows, "%1$s của %3$s so với %4$s năm %2$d chênh lệch bao nhiêu (%3$s − %4$s)?")


def paraphrases(samples: DataFrame, k: int = 4) -> DataFrame:
    """Up to k other wordings; one that changes nothing is left out."""
    q = F.col("question")
    end = F.lit("là bao nhiêu?")
    forms = [F.replace(q, end, F.lit("đạt mức nào?")), F.replace(q, end, F.lit("bằng bao nhiêu đơn vị?")), F.concat(F.lit("Xin cho biết "), F.lower(F.substring(q, 1, 1)), F.substr(q, F.lit(2))), F.replace(q, F.lit("năm "), F.lit("niên độ "))]
    out = samples.select("*", F.explode(F.filter(F.array(*forms[:k]), lambda f: f != q)).alias("other"))
    return out.withColumn("question", F.col("other")).drop("other")


def take(samples: DataFrame, quota: int, seed: int = 42) -> DataFrame:
    """At most ``quota`` (the feature) of each category by hash order, with their place n."""
    w = Window.partitionBy("category").orderBy(_pick(["question"], seed), "question", "pandas_query")
    return samples.withColumn("n", F.row_number().over(w)).where(F.col("n") <= quota)


def split(samples: DataFrame, seed: int = 42, tenth: int = 10) -> DataFrame:
    """A tenth held out, by hash of the question."""
    part = F.when(F.pmod(_pick(["question"], seed + 1), F.lit(tenth)) == 0, "holdout").otherwise("train")
    return samples.withColumn("part", part)


def balanced(categories: list[DataFrame], quota: int, seed: int = 42, threshold: float = 0.92) -> DataFrame:
    """At most ``quota`` of each category with ids; of near-duplicate questions the first by id stays; a tenth is held out."""
    few = take(reduce(DataFrame.unionByName, categories), quota, seed)
    named = staged(few.withColumn("question_id", F.format_string("%s_%06d", "category", "n")).drop("n"), "balanced")
    kept = first_of_near(named.select(F.col("question_id").alias("id"), F.col("question").alias("text")), threshold)
    return split(named.join(kept.select(F.col("id").alias("question_id")), "question_id", "left_semi"), seed)


def gold_set(categories: list[tuple[DataFrame, int]], least: int = 150, seed: int = 42) -> DataFrame:
    """A quota of each category, filled up to ``least`` from what is left, questions once, numbered q_0001 and so on."""
    every = reduce(DataFrame.unionByName, [take(df, 1 << 30, seed).withColumn("quota", F.lit(q)).withColumn("kind", F.lit(k)) for k, (df, q) in enumerate(categories)])
    once = Window.partitionBy("question").orderBy("kind", "n")
    every = every.withColumn("copy", F.row_number().over(once)).where("copy = 1")
    order = Window.orderBy((F.col("n") > F.col("quota")).cast("int"), "kind", "n", "question")
    least = max(least, sum(q for _, q in categories))
    # one partition numbers the set, which is as small as its size says
    ranked = every.withColumn("place", F.row_number().over(order)).where((F.col("place") <= least))
    return ranked.withColumn("question_id", F.format_string("q_%04d", "place")).drop("n", "quota", "kind", "copy", "place")


def template_code(question: Column, intent: Column, companies: Column, terms: Column, years: Column) -> Column:
    """The expression that a question's intent and entities stand for; first rule that fits."""
    low = F.lower(question)
    pair = F.regexp_extract_all(question, F.lit(r"\(([A-Z]{2,5})\s*[−\-–]\s*([A-Z]{2,5})\)"), F.lit(0))
    named = F.regexp_extract_all(F.get(pair, 0), F.lit("[A-Z]{2,5}"), F.lit(0))
    both = lambda c: F.concat(F.lit("answer = "), _value(company=F.get(c, 0)), F.lit(" - "), _value(company=F.get(c, 1)))
    has = lambda *words: reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    lo, hi = F.array_min(years), F.array_max(years)
    delta = F.concat(F.lit("answer = "), _value(year=hi), F.lit(" - "), _value(year=lo))
    change = F.concat(F.lit("a="), _value(year=hi), F.lit("; b="), _value(year=lo), F.lit("; answer = (a-b)/abs(b)*100 if b!=0 else None"))
    fixed = lambda a, sign, b: F.concat(F.lit("answer = "), _value(metric=F.lit(a)), F.lit(f" {sign} "), _value(metric=F.lit(b)))
    first = F.get(terms, 0)
    two = F.size(years) >= 2
    # fixed values: wordings that name two metrics
    return (
        F.when(F.size(named) == 2, both(named))
        .when((intent == "compare_companies") & (F.size(companies) >= 2), both(companies))
        .when(two & has("tăng", "giảm", "so với", "chênh") & has("phần trăm", "%", "cagr"), change).when(two & has("tăng", "giảm", "so với", "chênh"), delta)
        .when(two & intent.isin("compare_years", "trend") & first.isNotNull() & (F.size(companies) > 0), delta)
        .when(has("nợ ngắn hạn") & has("nợ dài hạn"), fixed("Nợ ngắn hạn", "+", "Nợ dài hạn"))
        .when(has("tiền") & has("hàng tồn kho"), fixed("Tiền và tương đương tiền", "+", "Hàng tồn kho"))
        .when(has("tài sản ngắn hạn") & has("tài sản dài hạn"), fixed("Tài sản ngắn hạn", "+", "Tài sản dài hạn"))
        .when((has("doanh thu thuần") & has("lnst")) | has("hiệu số"), fixed("Doanh thu thuần", "-", "LNST"))
        .when((intent == "calc_ratio") & (F.size(terms) >= 2), F.concat(F.lit("answer = "), _value(metric=first), F.lit(" / "), _value(metric=F.get(terms, 1)), F.lit(" * 100")))
        .when(first.isNotNull() & (F.size(companies) > 0) & (F.size(years) > 0), F.concat(F.lit("answer = "), _value(metric=first, year=F.get(years, 0).cast("string"), company=F.get(companies, 0))))
        .when(first.isNotNull(), F.concat(F.lit("answer = "), _value(metric=first))).otherwise("answer = float(df['giá_trị'].iloc[0])")
    )


def verified(samples: DataFrame, executed: DataFrame) -> DataFrame:
    """Samples with ``verified``: whether what executing the query gave (question_id, value) is the answer."""
    got = executed.select("question_id", F.col("value").alias("got"))
    return samples.join(got, "question_id", "left").withColumn("verified", answer_match(F.col("got"), F.col("answer"))).drop("got")


