"""Every query of the library with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.functions import numbers, text
from ledgerlens.operators import corpus, evaluation, ontology, retrieval
from ledgerlens.plans import facts as P
from ledgerlens.plans.facts import FACTS_SQL, facts_long, load

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _facts_sql(rest: str) -> str:
    return f"WITH {FACTS_SQL}, p AS (SELECT company, year, {', '.join(f'max(CASE WHEN metric = {chr(39)}{m}{chr(39)} THEN value END) AS {m}' for m in P.METRICS)} FROM facts GROUP BY ALL) {rest}"


@query(_facts_sql("SELECT company, year, metric, value FROM facts"))
def facts_unpivot(spark: SparkSession, d: str) -> DataFrame:
    """U5, E1."""
    return facts_long(spark, d)


@query(_facts_sql("SELECT company, year, arg_max(metric, (abs(value), chr(CAST(255 - ascii(metric) AS INTEGER)))) AS metric, max(abs(value)) AS value FROM facts GROUP BY ALL"))
def facts_argmax_abs(spark: SparkSession, d: str) -> DataFrame:
    """A9, W1."""
    return P.argmax_abs(facts_long(spark, d), ["company", "year"])


@query(_facts_sql("SELECT company, metric, arg_min(value, (value < 0, year)) AS answer FROM facts GROUP BY ALL"))
def op_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Lookup plan: Q11."""
    return P.first_nonnegative(facts_long(spark, d), "year")


@query(_facts_sql("SELECT company, year, extendedprice + tax_amt AS answer FROM p"))
def op_sum(spark: SparkSession, d: str) -> DataFrame:
    return P.binary(facts_long(spark, d), "sum", "extendedprice", "tax_amt")


@query(_facts_sql("SELECT company, year, extendedprice - discount_amt AS answer FROM p"))
def op_difference(spark: SparkSession, d: str) -> DataFrame:
    return P.binary(facts_long(spark, d), "difference", "extendedprice", "discount_amt")


@query(_facts_sql("SELECT company, year, CASE WHEN extendedprice = 0 THEN 0 ELSE discount_amt / extendedprice * 100 END AS answer FROM p"))
def op_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Zero denominators give 0."""
    return P.binary(facts_long(spark, d), "ratio", "discount_amt", "extendedprice")


_ENDS = "SELECT company, metric, arg_min(value, year) AS lo, arg_max(value, year) AS hi FROM facts GROUP BY ALL HAVING count(DISTINCT year) >= 2"


@query(_facts_sql(f"SELECT company, metric, hi - lo AS answer FROM ({_ENDS})"))
def op_year_delta(spark: SparkSession, d: str) -> DataFrame:
    """A14."""
    return P.over_years(facts_long(spark, d), "year_delta")


@query(_facts_sql(f"SELECT company, metric, CASE WHEN lo = 0 THEN 0 ELSE (hi - lo) / abs(lo) * 100 END AS answer FROM ({_ENDS})"))
def op_pct_change(spark: SparkSession, d: str) -> DataFrame:
    """A14, T16."""
    return P.over_years(facts_long(spark, d), "pct_change")


@query("SELECT c_nationkey, round(coalesce(avg(CASE WHEN c_acctbal >= 0 THEN c_acctbal END), avg(c_acctbal)), 4) AS answer FROM customer GROUP BY ALL")
def op_mean_nonneg(spark: SparkSession, d: str) -> DataFrame:
    """A8."""
    out = P.mean_nonnegative(load(spark, d, "customer"), "c_nationkey", "c_acctbal")
    return out.withColumn("answer", F.round("answer", 4))


def _extreme_sql(sign: str, answer: str) -> str:
    return _facts_sql(
        f"SELECT year, company, {answer} AS answer FROM p QUALIFY row_number() OVER (PARTITION BY year ORDER BY extendedprice {sign}, company) = 1"
    )


@query(_extreme_sql("DESC", "discount_amt"))
def op_argmax(spark: SparkSession, d: str) -> DataFrame:
    """A10, J15."""
    return P.extreme(facts_long(spark, d), "argmax", "year", "extendedprice", "discount_amt")


@query(_extreme_sql("ASC", "discount_amt"))
def op_argmin(spark: SparkSession, d: str) -> DataFrame:
    return P.extreme(facts_long(spark, d), "argmin", "year", "extendedprice", "discount_amt")


_RATIO = "CASE WHEN extendedprice = 0 THEN 0 ELSE discount_amt / extendedprice * 100 END"


@query(_extreme_sql("DESC", _RATIO))
def op_argmax_ratio(spark: SparkSession, d: str) -> DataFrame:
    """A11."""
    return P.extreme(facts_long(spark, d), "argmax_ratio", "year", "extendedprice", "discount_amt", "extendedprice")


@query(_extreme_sql("ASC", _RATIO))
def op_argmin_ratio(spark: SparkSession, d: str) -> DataFrame:
    return P.extreme(facts_long(spark, d), "argmin_ratio", "year", "extendedprice", "discount_amt", "extendedprice")


@query(_facts_sql("SELECT year, metric, count(DISTINCT company) AS answer FROM facts WHERE value > 1000 GROUP BY ALL"))
def op_count(spark: SparkSession, d: str) -> DataFrame:
    """A12, F7."""
    return facts_long(spark, d).where("value > 1000").groupBy("year", "metric").agg(F.countDistinct("company").alias("answer"))


@query(_facts_sql("SELECT b.company, b.metric, b.year, b.value - a.value AS delta FROM facts a JOIN facts b ON a.company = b.company AND a.metric = b.metric AND b.year = a.year + 1"))
def yoy_pairs(spark: SparkSession, d: str) -> DataFrame:
    """J4, Y9."""
    return P.lagged(facts_long(spark, d), 1).select("company", "metric", "year", (F.col("value") - F.col("before")).alias("delta"))


@query(_facts_sql("SELECT b.company, b.metric, b.year, round(power(b.value / a.value, 0.5) - 1, 9) AS cagr_fraction FROM facts a JOIN facts b ON a.company = b.company AND a.metric = b.metric AND b.year = a.year + 2 WHERE a.value > 0 AND b.value >= 0"))
def cagr2(spark: SparkSession, d: str) -> DataFrame:
    """J5, Y11, T17."""
    pairs = P.lagged(facts_long(spark, d), 2).where("before > 0 and value >= 0")
    return pairs.select("company", "metric", "year", F.round(F.pow(F.col("value") / F.col("before"), 0.5) - 1, 9).alias("cagr_fraction"))


@query(_facts_sql("SELECT * FROM (SELECT year, metric, company, lead(company) OVER w AS next_company, value - lead(value) OVER w AS diff FROM facts WINDOW w AS (PARTITION BY year, metric ORDER BY company)) WHERE next_company IS NOT NULL"))
def company_adjacent_diff(spark: SparkSession, d: str) -> DataFrame:
    """J7, W3, Y4."""
    w = Window.partitionBy("year", "metric").orderBy("company")
    out = facts_long(spark, d).withColumn("next_company", F.lead("company").over(w)).withColumn("diff", F.col("value") - F.lead("value").over(w))
    return out.where("next_company is not null").select("year", "metric", "company", "next_company", "diff")


@query(_facts_sql("SELECT company, year, quantity, extendedprice, discount_amt, tax_amt FROM p"))
def metric_pair_pivot(spark: SparkSession, d: str) -> DataFrame:
    """J6."""
    return facts_long(spark, d).groupBy("company", "year").pivot("metric", P.METRICS).agg(F.max("value"))


@query("SELECT o_orderkey, c_name, coalesce(c_acctbal, 0.0) AS confidence FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_mktsegment = 'BUILDING'")
def dim_left_join_default(spark: SparkSession, d: str) -> DataFrame:
    """A miss gives null and 0.0; the dimension is broadcast only if its size allows."""
    dim = load(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name", "c_acctbal")
    out = load(spark, d, "orders").select("o_orderkey", "o_custkey").join(dim, F.col("o_custkey") == F.col("c_custkey"), "left")
    return out.select("o_orderkey", "c_name", F.coalesce("c_acctbal", F.lit(0.0)).alias("confidence"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_todo(spark: SparkSession, d: str) -> DataFrame:
    """J12, J16."""
    orders = load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, d, "customer").join(orders, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def semi_hits(spark: SparkSession, d: str) -> DataFrame:
    """J11."""
    orders = load(spark, d, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, d, "customer").join(orders, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_diff(spark: SparkSession, d: str) -> DataFrame:
    """E3."""
    return load(spark, d, "customer").select(F.col("c_custkey").alias("k")).exceptAll(load(spark, d, "orders").select("o_custkey").distinct())


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    """E3."""
    return load(spark, d, "customer").select(F.col("c_custkey").alias("k")).intersect(load(spark, d, "orders").select("o_custkey"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def group_counts_sets(spark: SparkSession, d: str) -> DataFrame:
    """A1: several counts in one pass."""
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return load(spark, d, "lineitem").groupingSets([[flag], [status], []], flag, status).agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY ALL ORDER BY n DESC, event_type LIMIT 3")
def top_k_common(spark: SparkSession, d: str) -> DataFrame:
    """A2."""
    return load(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(3)


@query("SELECT source, count(*) AS n, count(*) FILTER (WHERE text ILIKE '%license%') AS with_licence, count(DISTINCT lang) AS langs, min(n_chars) AS lo, max(n_chars) AS hi, round(avg(n_chars), 4) AS mean FROM documents GROUP BY ALL")
def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    """A3-A5, A24, C12."""
    return load(spark, d, "documents").groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(F.lower("text").contains("license")).alias("with_licence"), F.countDistinct("lang").alias("langs"),
        F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"), F.round(F.avg("n_chars"), 4).alias("mean"),
    )


_RANKED = "SELECT s_nationkey, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) AS i, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier"


@query(f"SELECT s_nationkey, max(CASE WHEN i = 1 + CAST(round_even(0.5 * (n - 1), 0) AS BIGINT) THEN s_acctbal END) AS p50, max(CASE WHEN i = 1 + CAST(round_even(0.9 * (n - 1), 0) AS BIGINT) THEN s_acctbal END) AS p90 FROM ({_RANKED}) GROUP BY s_nationkey")
def nearest_rank_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Nearest rank, half-even; by window ranks, so that no group is collected."""
    w = Window.partitionBy("s_nationkey")
    ranked = load(spark, d, "supplier").select("s_nationkey", "s_acctbal", F.row_number().over(w.orderBy("s_acctbal")).alias("i"), F.count("*").over(w).alias("n"))
    at = lambda p: F.max(F.when(F.col("i") == 1 + F.bround(p * (F.col("n") - 1)).cast("long"), F.col("s_acctbal")))
    return ranked.groupBy("s_nationkey").agg(at(0.5).alias("p50"), at(0.9).alias("p90"))


@query("SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderstatus = 'F' DESC, o_orderpriority, o_orderdate, o_orderkey) AS rk FROM orders) WHERE rk <= 3")
def candidate_rank7(spark: SparkSession, d: str) -> DataFrame:
    """A multi-key order with a total tie-break; the limit is the feature."""
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), F.desc(F.col("o_orderstatus") == "F"), "o_orderpriority", "o_orderdate", "o_orderkey")
    return load(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(order).cast("long").alias("rk")).where("rk <= 3")


_TOKENS = "list_transform(regexp_extract_all(text, '[A-Za-zÀ-ỹ0-9%]+'), lambda x: lower(x))"


@query(f"SELECT doc_id, len({_TOKENS}) AS n_tokens, len(list_distinct({_TOKENS})) AS n_distinct FROM documents")
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    """N13."""
    words = text.tokenize_vi(F.col("text"))
    return load(spark, d, "documents").select("doc_id", F.size(words).cast("long").alias("n_tokens"), F.size(F.array_distinct(words)).cast("long").alias("n_distinct"))


@query("SELECT doc_id, trim(regexp_replace(replace(lower(strip_accents(text)), 'đ', 'd'), '[^a-z0-9%]+', ' ', 'g')) AS norm FROM documents")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    """N1, N4."""
    return load(spark, d, "documents").select("doc_id", text.normalized_text(F.col("text")).alias("norm"))


_QT = f"(SELECT item_id AS query_id, unnest({_TOKENS}) AS term FROM benchmark)"


@query(f"""WITH t AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents), post AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
dl AS (SELECT doc_id, len({_TOKENS}) AS dl FROM documents), s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM post, s GROUP BY term, n),
idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
sc AS (SELECT q.query_id, post.doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 4) AS score
  FROM (SELECT query_id, term, count(*) AS qtf FROM {_QT} GROUP BY ALL) q JOIN idf USING (term) JOIN post USING (term) JOIN dl ON dl.doc_id = post.doc_id, s GROUP BY ALL)
SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 20""")
def bm25_top20(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as queries."""
    items = load(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    out = retrieval.bm25(load(spark, d, "documents").select("doc_id", "text"), items)
    return out.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))


@query("""SELECT query_id, doc_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM
(SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0)) WHERE rank <= 10""")
def dense_top10(spark: SparkSession, d: str) -> DataFrame:
    """Every twentieth embedding as a query against all."""
    vectors = load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    out = retrieval.dense(vectors, vectors.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"), 10)
    return out.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), "score")


_DOCS = ("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS a, "
         "row_number() OVER (PARTITION BY source ORDER BY doc_id) AS b FROM documents")


@query(f"""WITH r AS ({_DOCS}), u AS (SELECT source AS query_id, doc_id, a AS rank FROM r UNION ALL SELECT source, doc_id, b FROM r),
f AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM u GROUP BY ALL)
SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 20""")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    """Two rankings of each source's documents, fused."""
    docs = load(spark, d, "documents").select("doc_id", "source", "n_chars")
    w = Window.partitionBy("source")
    a = docs.select(F.col("source").alias("query_id"), "doc_id", F.row_number().over(w.orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))
    b = docs.select(F.col("source").alias("query_id"), "doc_id", F.row_number().over(w.orderBy("doc_id")).alias("rank"))
    return retrieval.fuse(a.unionByName(b)).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query("""WITH g AS (SELECT source, list(doc_id) FILTER (WHERE lang = 'en') AS gold, list(doc_id ORDER BY n_chars DESC, doc_id) AS found FROM documents GROUP BY source),
m AS (SELECT source, len(list_intersect(found[1:20], gold)) AS hit, len(gold) AS n FROM g)
SELECT source, round(hit / n, 9) AS recall20, round(CASE WHEN hit = 0 THEN 0 ELSE 5 * (hit/20.0) * (hit/n) / (4 * (hit/20.0) + hit/n) END, 9) AS f2 FROM m WHERE n > 0""")
def recall_f2(spark: SparkSession, d: str) -> DataFrame:
    """By counts, without collecting lists."""
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    docs = load(spark, d, "documents").select("source", (F.col("lang") == "en").alias("gold"), F.row_number().over(w).alias("r"))
    m = docs.groupBy("source").agg(F.count_if(F.col("gold") & (F.col("r") <= 20)).alias("hit"), F.count_if("gold").alias("n")).where("n > 0")
    p, r = F.col("hit") / 20.0, F.col("hit") / F.col("n")
    return m.select("source", F.round(r, 9).alias("recall20"), F.round(numbers.f2(p, r), 9).alias("f2"))


@query("""SELECT l_orderkey, l_linenumber, c AS cell, CAST(replace(replace(replace(c, '.', ''), ',', '.'), '%', '') AS DOUBLE) AS value FROM
(SELECT l_orderkey, l_linenumber, CAST(CAST(floor(l_extendedprice) AS BIGINT) // 1000 AS VARCHAR) || '.' || lpad(CAST(CAST(floor(l_extendedprice) AS BIGINT) % 1000 AS VARCHAR), 3, '0') || ',5' AS c FROM lineitem)""")
def vn_number_parse(spark: SparkSession, d: str) -> DataFrame:
    """Prices written with dots for thousands, then parsed."""
    whole = F.floor("l_extendedprice").cast("long")
    cell = F.concat(F.floor(whole / 1000).cast("string"), F.lit("."), F.lpad((whole % 1000).cast("string"), 3, "0"), F.lit(",5"))
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", cell.alias("cell"), numbers.parse_vn_number(cell).alias("value"))


def _has(*words: str) -> str:
    return "(" + " OR ".join(f"contains(n, '{w}')" for w in words) + ")"


_SHARE, _MOVED = _has("ty le", "phan tram", "%", "chiem bao nhieu"), _has("tang", "giam", "thay doi", "so voi", "cagr")


@query(f"""SELECT conv_id, turn,
CASE WHEN {_has('bao nhieu cong ty', 'bao nhieu ngan hang', 'co bao nhieu')} THEN 'count' WHEN {_has('trung binh', 'gia tri binh quan')} THEN 'mean'
WHEN {_has('thap nhat', 'nho nhat')} THEN CASE WHEN {_SHARE} AND terms >= 3 THEN 'argmin_ratio' ELSE 'argmin' END
WHEN {_has('cao nhat', 'lon nhat')} THEN CASE WHEN {_SHARE} AND terms >= 3 THEN 'argmax_ratio' ELSE 'argmax' END
WHEN {_SHARE} AND terms >= 2 THEN 'ratio' WHEN {_has('tong', 'cong lai')} AND terms >= 2 THEN 'sum' WHEN {_has('chenh lech', 'hieu so', 'tru ')} AND terms >= 2 THEN 'difference'
WHEN years >= 2 AND {_MOVED} THEN CASE WHEN {_has('phan tram', '%', 'cagr')} THEN 'pct_change' ELSE 'year_delta' END ELSE 'lookup' END AS operation,
CASE WHEN contains(' ' || n, ' rieng') OR {_has('cong ty me')} THEN 'separate' WHEN {_has('hop nhat')} THEN 'consolidated' ELSE 'any' END AS scope,
CASE WHEN {_has('nghin ty')} THEN 1e12 WHEN {_has('tram ty')} THEN 1e11 WHEN {_has('trieu')} THEN 1e6 WHEN {_has('ty dong', 'ty vnd', 'tinh bang ty', 'don vi ty')} THEN 1e9 ELSE 1.0 END AS scale
FROM (SELECT conv_id, turn, turn % 4 AS terms, conv_id % 3 AS years, trim(regexp_replace(replace(lower(strip_accents(question)), 'đ', 'd'), '[^a-z0-9%]+', ' ', 'g')) || ' ' AS n FROM
(SELECT conv_id, turn, coalesce(text, '') || ' ' || list_extract(['tổng', 'tỷ lệ', 'cao nhất', 'thấp nhất', 'trung bình', 'chênh lệch', 'tăng giảm', 'có bao nhiêu', 'phần trăm so với', 'hợp nhất triệu', 'riêng tỷ đồng', 'nghìn tỷ', 'nhỏ nhất chiếm bao nhiêu'], CAST((conv_id * 7 + turn) % 13 AS INTEGER) + 1) AS question FROM conversations))""")
def intent_scope_unit(spark: SparkSession, d: str) -> DataFrame:
    """Q6, N9, N10 over conversation turns that end in words of the questions, with 0 to 3 terms and 0 to 2 years."""
    ends = ["tổng", "tỷ lệ", "cao nhất", "thấp nhất", "trung bình", "chênh lệch", "tăng giảm", "có bao nhiêu", "phần trăm so với", "hợp nhất triệu", "riêng tỷ đồng", "nghìn tỷ", "nhỏ nhất chiếm bao nhiêu"]
    end = F.get(F.array(*map(F.lit, ends)), ((F.col("conv_id") * 7 + F.col("turn")) % 13).cast("int"))
    t = load(spark, d, "conversations").select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), end).alias("q"))
    q = F.col("q")
    return t.select("conv_id", "turn", text.infer_operation(q, F.col("turn") % 4, F.col("conv_id") % 3).alias("operation"), text.detect_scope(q).alias("scope"), text.target_scale(q).alias("scale"))


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS header_turn FROM conversations""")
def asof_header(spark: SparkSession, d: str) -> DataFrame:
    """The last header within ten rows."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-10, 0)
    return load(spark, d, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), True).over(w).alias("header_turn"))


@query("""SELECT user_id, island, count(*) AS n, min(event_id) AS first_event FROM (SELECT user_id, event_id, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM
(SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS brk FROM events)) GROUP BY ALL""")
def islands(spark: SparkSession, d: str) -> DataFrame:
    """Runs of one event type of each user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    marked = load(spark, d, "events").withColumn("brk", F.when(F.col("event_type") == F.lag("event_type").over(w), 0).otherwise(1))
    return marked.withColumn("island", F.sum("brk").over(w)).groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("""WITH r AS (SELECT l.doc_id, d.doc_id IS NOT NULL AS retrieved, l.quality = 1 AS executed, CAST(l.doc_id % 5 AS DOUBLE) * list_extract([1.0, 1000.0, 0.000001, 1.0], CAST(l.doc_id % 4 AS INTEGER) + 1) AS got,
CAST((l.doc_id % 5) * CASE WHEN l.toxic = 1 THEN 7 ELSE 1 END AS DOUBLE) AS gold FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id AND d.lang <> 'fr'),
k AS (SELECT CASE WHEN NOT retrieved THEN 'retrieval_miss' WHEN NOT executed THEN 'execution_fail_unrepaired' WHEN abs(got - gold) <= 1.0 OR abs(got - gold) <= 0.001 * abs(gold) THEN 'ok'
WHEN gold <> 0 AND (abs(abs(got / gold) - 1000) < 0.05 OR abs(abs(got / gold) - 0.001) < 0.05 OR abs(abs(got / gold) - 1e6) < 0.05 OR abs(abs(got / gold) - 1e-6) < 0.05 OR abs(abs(got / gold) - 1e9) < 0.05 OR abs(abs(got / gold) - 1e-9) < 0.05) THEN 'unit_mismatch'
ELSE 'generation_wrong_logic' END AS category FROM r) SELECT category, count(*) AS n, round(count(*) / (SELECT count(*) FROM k), 9) AS rate FROM k GROUP BY category""")
def error_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Labels as answers, right, far off or in another unit."""
    from ledgerlens.operators.submission import classify_error

    docs = load(spark, d, "documents").where("lang <> 'fr'").select(F.col("doc_id").alias("id"))
    rows = load(spark, d, "labels").join(docs, F.col("doc_id") == F.col("id"), "left")
    times = F.get(F.array(*map(F.lit, (1.0, 1000.0, 0.000001, 1.0))), (F.col("doc_id") % 4).cast("int"))
    got, gold = (F.col("doc_id") % 5).cast("double") * times, ((F.col("doc_id") % 5) * F.when(F.col("toxic") == 1, 7).otherwise(1)).cast("double")
    counts = rows.groupBy(classify_error(F.col("id").isNotNull(), F.col("quality") == 1, got, gold).alias("category")).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(rows.agg(F.count("*").alias("all")))).select("category", "n", F.round(F.col("n") / F.col("all"), 9).alias("rate"))


@query("""WITH v AS (SELECT user_id AS question_id, event_type AS strategy, event_id AS seq, round_even(value, 0) AS value FROM events WHERE value IS NOT NULL),
g AS (SELECT question_id, value, count(*) AS n_agree, min(seq) AS first, arg_min(strategy, seq) AS strategy FROM v GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY n_agree DESC, first) AS r, sum(n_agree) OVER (PARTITION BY question_id) AS n FROM g)
SELECT question_id, value, strategy, n_agree, CAST(n AS BIGINT) AS n_candidates FROM r WHERE r = 1""")
def mode_vote(spark: SparkSession, d: str) -> DataFrame:
    """users' events as strategies' answers, rounded to whole numbers."""
    from ledgerlens.plans.pack import vote

    return vote(load(spark, d, "events").select(F.col("user_id").alias("question_id"), F.col("event_type").alias("strategy"), F.col("event_id").alias("seq"), "value"), 0)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_project(spark: SparkSession, d: str) -> DataFrame:
    """S5, S10, N24."""
    return load(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query(_facts_sql("SELECT metric_norm, min(metric) AS label, count(*) AS n FROM (SELECT replace(metric, '_', ' ') AS metric_norm, metric FROM facts) GROUP BY metric_norm"))
def metric_catalog(spark: SparkSession, d: str) -> DataFrame:
    """A16, D11."""
    return facts_long(spark, d).groupBy(text.normalized_text(F.col("metric")).alias("metric_norm")).agg(F.min("metric").alias("label"), F.count("*").alias("n"))


@query(_facts_sql("SELECT company, year, metric, row_number() OVER (PARTITION BY company ORDER BY year, metric) - 1 AS row_id FROM facts"))
def evidence_row_ids(spark: SparkSession, d: str) -> DataFrame:
    """W2, Q14."""
    w = Window.partitionBy("company").orderBy("year", "metric")
    return facts_long(spark, d).select("company", "year", "metric", (F.row_number().over(w) - 1).cast("long").alias("row_id"))


@query()
def fuzzy_ontology_join(spark: SparkSession, d: str) -> DataFrame:
    """Distinct part types against all of them as aliases; each is its own, so all are exact (``misspelt_names`` has those that aren't)."""
    terms = load(spark, d, "part").select(F.lower("p_type").alias("raw")).distinct()
    index = ontology.alias_index(terms.select(F.col("raw").alias("alias"), F.col("raw").alias("canonical"), F.col("raw").alias("seq")))
    mapped = ontology.map_terms(terms, index)
    confidence = F.when(F.col("canonical").isNotNull(), 100 * F.col("confidence")).otherwise(0.0)
    return mapped.select("raw", "canonical", confidence.alias("confidence"))


#: A name with its words in the other order and one letter left out or doubled, by the part's number.
_AT = "1 + p_partkey % length(n)"
_DAMAGED = f"""SELECT DISTINCT trim(regexp_replace(CASE WHEN p_partkey % 5 = 0 THEN n WHEN p_partkey % 2 = 0 THEN left(n, CAST({_AT} AS INTEGER) - 1) || substr(n, CAST({_AT} AS INTEGER) + 1)
ELSE left(n, CAST({_AT} AS INTEGER)) || substr(n, CAST({_AT} AS INTEGER)) END, ' +', ' ', 'g')) AS raw
FROM (SELECT p_partkey, split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) AS n FROM part)"""
_WORDS = "array_to_string(list_sort(string_split({}, ' ')), ' ')"


def _lcs_sql() -> str:
    """Longest common subsequences of strings a and b in DuckDB: a row of lengths for each letter of b, its running maxima."""
    step = "list_transform(range(1, length(a) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda i: greatest(row[i], CASE WHEN a[CAST(i AS INTEGER)] = chr(CAST(x[1] AS INTEGER)) THEN coalesce(row[i - 1], 0) + 1 ELSE 0 END))))"
    return f"list_extract(list_reduce(list_transform(range(1, length(b) + 1), lambda k: [CAST(unicode(b[CAST(k AS INTEGER)]) AS BIGINT)]), lambda row, x: {step}, list_transform(range(1, length(a) + 1), lambda k: CAST(0 AS BIGINT))), -1)"


@query(f"""WITH t AS ({_DAMAGED}), n AS (SELECT DISTINCT p_name AS alias FROM part), p AS (SELECT raw, alias, {_WORDS.format('raw')} AS a, {_WORDS.format('alias')} AS b FROM t, n),
s AS (SELECT raw, alias, CASE WHEN raw = alias THEN 101.0 ELSE 200.0 * {_lcs_sql()} / (length(a) + length(b)) END AS score FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY score DESC, alias) AS k FROM s)
SELECT raw, CASE WHEN score >= 85 THEN alias END AS canonical, round(least(score, 100.0), 6) AS confidence FROM r WHERE k = 1""")
def misspelt_names(spark: SparkSession, d: str) -> DataFrame:
    """Part names with words in the other order and a letter too few or too many against all names as aliases."""
    part = load(spark, d, "part")
    words = F.split("p_name", " ")
    n = F.concat(F.get(words, 1), F.lit(" "), F.get(words, 0))
    at = (F.col("p_partkey") % F.length("n") + 1).cast("int")
    cut = lambda a, b: F.concat(F.substr("n", F.lit(1), a), F.substr("n", b))
    damaged = F.when(F.col("p_partkey") % 5 == 0, F.col("n")).when(F.col("p_partkey") % 2 == 0, cut(at - 1, at + 1)).otherwise(cut(at, at))
    terms = part.select("p_partkey", n.alias("n")).select(F.trim(F.regexp_replace(damaged, " +", " ")).alias("raw")).distinct()
    names = part.select(F.col("p_name").alias("alias"), F.col("p_name").alias("canonical"), F.lit(0).alias("seq")).distinct()
    mapped = ontology.map_terms(terms, ontology.alias_index(names))
    return mapped.select("raw", "canonical", F.round(100 * F.col("confidence"), 6).alias("confidence"))


@query("SELECT doc_id, CASE WHEN substr(md5(doc_id || '|42'), 1, 2) < '1a' THEN 'holdout' ELSE 'train' END AS part FROM documents")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    """A seeded tenth as holdout, by a hash of the id that other engines have as well."""
    held = F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("|42"))), 1, 2) < "1a"
    return load(spark, d, "documents").select("doc_id", F.when(held, "holdout").otherwise("train").alias("part"))


_SETS = f"SELECT doc_id, list_sort(list_distinct({_TOKENS})) AS t FROM documents"


@query(f"""WITH s AS (SELECT min(doc_id) AS id, t FROM ({_SETS}) GROUP BY t),
p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.t, b.t)) AS i, len(a.t) AS x, len(b.t) AS y FROM s a JOIN s b ON a.id < b.id AND len(a.t) > 0 AND least(len(a.t), len(b.t)) >= 0.92 * greatest(len(a.t), len(b.t))),
n AS (SELECT a, b FROM p WHERE i / (x + y - i) >= 0.92), l AS (SELECT id, count(*) AS k FROM (SELECT a AS id FROM n UNION ALL SELECT b FROM n) GROUP BY id)
SELECT d.doc_id AS id, s.id AS class_id, coalesce(l.k, 0) AS n_links FROM ({_SETS}) d JOIN s ON d.t = s.t LEFT JOIN l ON l.id = s.id""")
def near_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each document's class of equal token sets and the number of classes near it."""
    from ledgerlens.operators.dedupe import linked

    return linked(load(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Time windows as a streaming job has them, over the whole table as a batch."""
    from ledgerlens.streaming.ingest import windowed_counts

    return windowed_counts(load(spark, d, "events"))


@query(_facts_sql("SELECT company, max(CASE WHEN metric = 'extendedprice' AND year = 1997 THEN value END) / max(CASE WHEN metric = 'quantity' AND year = 1997 THEN value END) * 100 AS answer FROM facts GROUP BY company"))
def grammar_ratio(spark: SparkSession, d: str) -> DataFrame:
    """An expression compiled to one aggregation, for all companies at once."""
    from ledgerlens.operators.grammar import compile_expression

    part = "float(df[(df['metric']=='{}')&(df['năm']==1997)]['giá_trị'].iloc[0])"
    both = compile_expression(f"{part.format('extendedprice')} / {part.format('quantity')} * 100", order="year")
    return facts_long(spark, d).groupBy("company").agg(both.alias("answer"))


@query("SELECT page_id, len(regexp_extract_all(html, '(?i)<li[ >]')) AS n_items, len(regexp_extract_all(html, '(?i)<table')) AS n_tables FROM pages")
def html_rows(spark: SparkSession, d: str) -> DataFrame:
    """X1."""
    n = lambda p: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(0))).cast("long")
    return load(spark, d, "pages").select("page_id", n("(?i)<li[ >]").alias("n_items"), n("(?i)<table").alias("n_tables"))


def _long(spark: SparkSession, d: str) -> DataFrame:
    """Facts with the columns of long rows; a report of each company, a table of each year."""
    return facts_long(spark, d).select(
        F.col("company").cast("string").alias("report_id"), F.col("year").cast("string").alias("start_line"), "company", "year",
        F.lit("CDKT").alias("table_type"), F.lit("VND").alias("unit"), F.col("metric").alias("canonical"), F.replace("metric", F.lit("_"), F.lit(" ")).alias("metric"), F.col("metric").alias("seq"),
    )


@query(_facts_sql("""SELECT company || '|' || year AS table_key, company, year, 'Công ty: ' || company || ' | Năm: ' || year || ' | Loại bảng: CDKT | Đơn vị: VND | report: ' || company || ' | ' ||
string_agg(CASE WHEN contains(metric, '_') THEN metric || ' | ' || replace(metric, '_', ' ') ELSE metric END, ' | ' ORDER BY metric) AS text FROM facts GROUP BY company, year"""))
def table_corpus(spark: SparkSession, d: str) -> DataFrame:
    """R1, R11, A15."""
    return corpus.table_documents(_long(spark, d))


@query(_facts_sql("""SELECT DISTINCT company || '|' || year AS table_key, company, year, metric AS canonical, 'Công ty ' || company || ' ticker ' || company || ' năm ' || year || ' CDKT ' || metric || ' ' || replace(metric, '_', ' ') || ' report ' || company AS text FROM facts"""))
def metric_corpus(spark: SparkSession, d: str) -> DataFrame:
    """R2, E7."""
    return corpus.metric_documents(_long(spark, d))


@query("SELECT role, role IS NULL AS overall, count(*) AS n, round(avg(length(text)), 6) AS length FROM conversations GROUP BY ROLLUP (role)")
def rollup_means(spark: SparkSession, d: str) -> DataFrame:
    """A17."""
    rows = load(spark, d, "conversations").select("role", F.length("text").alias("length"))
    return evaluation.means_by(rows, "role", ["length"]).withColumn("length", F.round("length", 6))


_KINDS = {"licence": "license", "number": "[0-9]{4,}", "mail": "@"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS pattern, count(*) FILTER (WHERE regexp_matches(text, '{p}', 'i')) AS n FROM documents" for k, p in _KINDS.items()))
def pattern_frequency(spark: SparkSession, d: str) -> DataFrame:
    """A23."""
    return evaluation.pattern_counts(load(spark, d, "documents"), "text", _KINDS)


@query("""SELECT n_name, count(c_custkey) AS n, round(count(c_custkey) / (SELECT count(*) FROM customer), 9) AS share, count(c_custkey) / (SELECT count(*) FROM customer) < 0.05 AS rare
FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name""")
def category_shares(spark: SparkSession, d: str) -> DataFrame:
    """A22, C13."""
    nations = load(spark, d, "nation").select("n_name", F.col("n_nationkey").alias("c_nationkey"))
    rows = load(spark, d, "customer").select("c_nationkey").join(nations, "c_nationkey")
    return evaluation.shares(rows, nations, "n_name").withColumn("share", F.round("share", 9))


@query("""SELECT 'customers' AS gate, CAST(count(*) AS DOUBLE) AS value, 1.0 AS least, count(*) >= 1 AS passed FROM customer UNION ALL
SELECT 'solvent', round(avg(CASE WHEN c_acctbal >= 0 THEN 1.0 ELSE 0 END), 9), 2.0, false FROM customer""")
def gate_report(spark: SparkSession, d: str) -> DataFrame:
    """C11."""
    solvent = F.round(F.avg((F.col("c_acctbal") >= 0).cast("double")), 9)
    return evaluation.gates(load(spark, d, "customer"), {"customers": (F.count("*"), 1), "solvent": (solvent, 2)})


#: What the facts' metrics are called in reports and questions; report years lie in the range of years that headers may name.
SHEET = {"quantity": "Hàng tồn kho", "extendedprice": "Tài sản ngắn hạn", "discount_amt": "Phải thu khách hàng", "tax_amt": "Thuế phải nộp"}
ASKED = {"quantity": "Doanh thu thuần", "extendedprice": "Tài sản ngắn hạn", "discount_amt": "Chi phí bán hàng", "tax_amt": "Giá vốn hàng bán"}
LATER = 20


def _named(names: dict[str, str]):
    return F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), F.col("metric"))


def reports_of(facts: DataFrame) -> DataFrame:
    """path, text of a report for each company: a title, a unit and a table of its metrics by year."""
    whole = F.floor("value").cast("decimal(20,0)")
    cell = F.translate(F.format_number(whole, 0), ",", ".")
    rows = facts.select("company", (F.col("year") + LATER).alias("year"), "metric", _named(SHEET).alias("label"), cell.alias("cell"))
    lines = rows.groupBy("company", "metric", "label").agg(F.array_sort(F.collect_list(F.struct("year", "cell"))).alias("cells"))
    td = lambda tag, c: F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))
    body = F.concat(F.lit("<tr>"), td("td", F.col("label")), td("td", F.lit("100")), F.array_join(F.transform("cells", lambda x: td("td", x["cell"])), ""), F.lit("</tr>"))
    head = F.array_join(F.transform("cells", lambda x: td("th", F.concat(F.lit("Năm "), x["year"].cast("string")))), "")
    tables = lines.select("company", "metric", body.alias("body"), head.alias("head")).groupBy("company").agg(F.min("head").alias("head"), F.array_sort(F.collect_list(F.struct("metric", "body"))).alias("b"))
    table = F.concat(F.lit("<table><tr><th>Chỉ tiêu</th><th>Mã số</th>"), F.col("head"), F.lit("</tr>\n"), F.array_join(F.transform("b", lambda x: x["body"]), "\n"), F.lit("</table>"))
    text_ = F.concat(F.lit("BÁO CÁO TÀI CHÍNH HỢP NHẤT\nĐơn vị: VND\nBẢNG CÂN ĐỐI KẾ TOÁN\n\n"), table, F.lit("\n<table><tr><td>Mục lục</td><td>Trang</td></tr><tr><td>x</td><td>3</td></tr></table>\n"))
    path = F.concat(F.lit("/data/financial_statements/"), F.col("company"), F.lit("/2021/"), F.col("company"), F.lit("_consolidated_extracted.txt"))
    return tables.select(path.alias("path"), text_.alias("text"))


@query(_facts_sql("""SELECT company || '_consolidated' AS report_id, 2 AS start_line, 8 AS end_line, 'CDKT' AS table_type, 'Đơn vị: VND' AS unit, company, 2021 AS year, true AS is_consolidated, 5 AS n_rows, 'html' AS source FROM facts GROUP BY company"""))
def extract_tables(spark: SparkSession, d: str) -> DataFrame:
    """The tables of reports rendered from the facts; tables of contents aren't among them."""
    from ledgerlens.operators import extraction

    out = extraction.extract_tables(reports_of(facts_long(spark, d)))
    return out.select("report_id", "start_line", "end_line", "table_type", "unit", "company", "year", "is_consolidated", F.size("rows").alias("n_rows"), "source")


_TABLES_SQL = ORACLE_SQL["extract_tables"]


@query(_TABLES_SQL)
def ingested_tables(spark: SparkSession, d: str) -> DataFrame:
    """2.18, S1, X16, K3: the same reports as files of their own, read as a stream in batches, with extraction inside it."""
    from ledgerlens.sources import files, staging
    from ledgerlens.streaming import ingest

    root = staging.staging_folder(spark, "reports")
    made = reports_of(facts_long(spark, d))
    files.write_files(made.select(F.substring("path", 2, 1000).alias("name"), F.col("text").alias("content")), f"{root}/in")
    out = ingest.ingest_reports(spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint", 500)
    return out.select("report_id", "start_line", "end_line", "table_type", "unit", "company", "year", "is_consolidated", F.size("rows").alias("n_rows"), "source")


@query(_TABLES_SQL)
def extract_in_sql(spark: SparkSession, d: str) -> DataFrame:
    """2.17: extraction as a table function of SQL."""
    from ledgerlens.operators import extraction

    extraction.register(spark)
    return spark.sql("SELECT report_id, start_line, end_line, table_type, unit, company, year, is_consolidated, size(rows) AS n_rows, source FROM {reports}, LATERAL extract_tables(path, text, false)",
                     reports=reports_of(facts_long(spark, d)))


@query(_facts_sql(f"SELECT company, year + {LATER} AS year, CASE metric {' '.join(f'WHEN {chr(39)}{m}{chr(39)} THEN {chr(39)}{n}{chr(39)}' for m, n in SHEET.items())} END AS metric_raw, floor(value) AS value, 'Đơn vị: VND' AS unit FROM facts"))
def longify_facts(spark: SparkSession, d: str) -> DataFrame:
    """Reports rendered from the facts, extracted and unpivoted, are the facts again."""
    from ledgerlens.operators import extraction, longify

    return longify.longify(extraction.extract_tables(reports_of(facts_long(spark, d)))).select("company", "year", "metric_raw", "value", "unit")


@query(_facts_sql(f"SELECT company, year + {LATER} AS year, count(*) AS n FROM facts GROUP BY ALL"))
def longify_notes(spark: SparkSession, d: str) -> DataFrame:
    """The same tables read as notes."""
    from ledgerlens.operators import extraction, longify

    return longify.longify(extraction.extract_tables(reports_of(facts_long(spark, d))), True).groupBy("company", "year").agg(F.count("*").alias("n"))


#: Operation -> question of a company, and its answer over the pivoted facts q (of the company) in SQL.
QUESTIONS = {
    "lookup": ("Doanh thu thuần của %s năm 1997 là bao nhiêu?", "max(quantity) FILTER (WHERE year = 1997)"),
    "sum": ("Tổng Giá vốn hàng bán và Chi phí bán hàng của %s năm 1997?", "max(tax_amt) FILTER (WHERE year = 1997) + max(discount_amt) FILTER (WHERE year = 1997)"),
    "difference": ("Chênh lệch giữa Doanh thu thuần và Chi phí bán hàng của %s năm 1997?", "max(quantity) FILTER (WHERE year = 1997) - max(discount_amt) FILTER (WHERE year = 1997)"),
    "ratio": ("Tỷ lệ Chi phí bán hàng trên Doanh thu thuần của %s năm 1997?", "max(discount_amt) FILTER (WHERE year = 1997) / max(quantity) FILTER (WHERE year = 1997) * 100"),
    "year_delta": ("Doanh thu thuần của %s năm 1998 thay đổi bao nhiêu so với 1997?", "max(quantity) FILTER (WHERE year = 1998) - max(quantity) FILTER (WHERE year = 1997)"),
    "pct_change": ("Doanh thu thuần của %s năm 1998 tăng bao nhiêu phần trăm so với 1997?", "(max(quantity) FILTER (WHERE year = 1998) - max(quantity) FILTER (WHERE year = 1997)) / abs(max(quantity) FILTER (WHERE year = 1997)) * 100"),
    "mean": ("Giá vốn hàng bán trung bình của %s?", "avg(tax_amt)"),
    "argmax": ("Năm mà Doanh thu thuần của %s cao nhất thì Chi phí bán hàng là bao nhiêu?", "arg_max(discount_amt, (quantity, -year))"),
    "argmin": ("Chi phí bán hàng vào năm mà Doanh thu thuần của %s thấp nhất?", "arg_min(discount_amt, (quantity, year))"),
    "argmax_ratio": ("Năm mà Doanh thu thuần của %s lớn nhất thì tỷ lệ Chi phí bán hàng trên Giá vốn hàng bán là bao nhiêu?", "arg_max(discount_amt / tax_amt * 100, (quantity, -year))"),
    "argmin_ratio": ("Chi phí bán hàng chiếm bao nhiêu Giá vốn hàng bán của %s vào năm mà Doanh thu thuần nhỏ nhất?", "arg_min(discount_amt / tax_amt * 100, (quantity, year))"),
    "count": ("Có bao nhiêu công ty như %s có Giá vốn hàng bán năm 1997?", "CAST(count(*) FILTER (WHERE year = 1997) AS DOUBLE)"),
}


def questions_of(facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts as the planner reads them, a question of each operation about each company, and the companies' aliases."""
    rows = facts.select(
        "company", "year", _named(ASKED).alias("metric"), F.lit(None).cast("string").alias("canonical"), "value", F.lit("VND").alias("unit"), F.lit(False).alias("is_consolidated"),
        F.concat(F.lit("r"), F.col("year").cast("string")).alias("report_id"), F.lit(1).alias("start_line"),
    )
    name = F.concat(F.reverse(F.regexp_extract("company", "[0-9]+", 0)), F.lit(" supplier"))
    companies = facts.select("company").distinct()
    asked = [F.struct(F.concat(F.col("company"), F.lit(f"|{op}")).alias("question_id"), F.format_string(q, name).alias("question")) for op, (q, _) in QUESTIONS.items()]
    return rows, companies.select(F.explode(F.array(*asked)).alias("q")).select("q.*"), companies.select(name.alias("alias"), F.col("company").alias("ticker"))


@query(_facts_sql(" UNION ALL ".join(f"SELECT company || '|{op}' AS question_id, '{op}' AS operation, round({a}, 4) AS answer, 'ok' AS status FROM p GROUP BY company" for op, (_, a) in QUESTIONS.items())))
def planner_answers(spark: SparkSession, d: str) -> DataFrame:
    """Q3-Q10, F1-F3, J9, J10, O1, W7, 2.15: a question of each of the twelve operations about each company."""
    from ledgerlens.plans.questions import answer_questions

    out = answer_questions(*questions_of(facts_long(spark, d)))
    return out.select("question_id", "operation", F.round("answer", 4).alias("answer"), "status")


@query(_facts_sql(" UNION ALL ".join(f"SELECT company || '|{op}' AS question_id, 'ok' AS status, round({a}, 4) AS value FROM p GROUP BY company" for op, (_, a) in QUESTIONS.items())))
def planner_queries(spark: SparkSession, d: str) -> DataFrame:
    """The planner's expressions, read by the grammar and computed over the submitted evidence."""
    from ledgerlens.plans import pack

    rows, asked, aliases = questions_of(facts_long(spark, d))
    made, evidence = pack.pack(rows, asked, aliases)
    done = pack.execute(made.select(F.col("id").alias("question_id"), "pandas_query"), evidence)
    return done.select("question_id", "status", F.round("value", 4).alias("value"))


_GENERATED = """SELECT 'lookup_simple' AS category, company, year, metric, value AS answer FROM facts WHERE abs(value) >= 1000
UNION ALL SELECT 'unit_rounding', company, year, metric, round_even(value / 1e9, 1) FROM facts WHERE abs(value) >= 1000
UNION ALL SELECT 'negative_value', company, year, metric, value FROM facts WHERE value < 0
UNION ALL SELECT 'yoy_abs_diff', b.company, b.year, b.metric, b.value - a.value FROM facts a JOIN facts b ON a.company = b.company AND a.metric = b.metric AND b.year = a.year + 1
UNION ALL SELECT 'compare_2years', b.company, b.year, b.metric, (b.value - a.value) / abs(a.value) * 100 FROM facts a JOIN facts b ON a.company = b.company AND a.metric = b.metric AND b.year = a.year + 1 WHERE a.value <> 0
UNION ALL SELECT 'cagr', b.company, b.year, b.metric, power(b.value / a.value, 0.5) - 1 FROM facts a JOIN facts b ON a.company = b.company AND a.metric = b.metric AND b.year = a.year + 2 WHERE a.value > 0 AND b.value >= 0
UNION ALL SELECT * FROM (SELECT 'compare_companies', company, year, metric, value - lead(value) OVER (PARTITION BY year, metric ORDER BY company) AS d FROM facts WHERE abs(value) >= 1000) WHERE d IS NOT NULL"""


@query(_facts_sql(f"SELECT category, company, year, metric, round(answer, 6) AS answer FROM ({_GENERATED})"))
def generated_samples(spark: SparkSession, d: str) -> DataFrame:
    """All samples of the generators of one and two values."""
    from functools import reduce

    from ledgerlens.plans import generate as G

    f = facts_long(spark, d)
    every = reduce(DataFrame.unionByName, [G.lookup(f), G.unit_round(f), G.negative(f), G.year_difference(f), G.compare_years(f), G.growth(f), G.compare_neighbours(f)])
    return every.select("category", F.get("companies", 0).alias("company"), F.element_at("years", -1).alias("year"), F.get("metrics", 0).alias("metric"), F.round("answer", 6).alias("answer"))


@query(_facts_sql("""SELECT CASE kind WHEN 'ratio' THEN 'ratio_structure' WHEN 'index' THEN 'financial_index' WHEN 'sum' THEN 'sum_two' ELSE 'multi_table' END AS category, company, year,
round(CASE kind WHEN 'sum' THEN extendedprice + tax_amt WHEN 'difference' THEN extendedprice - tax_amt WHEN 'turnover' THEN extendedprice / tax_amt ELSE extendedprice / tax_amt * 100 END, 6) AS answer
FROM p, (SELECT unnest(['ratio', 'index', 'turnover', 'sum', 'difference']) AS kind) WHERE kind IN ('sum', 'difference') OR abs(tax_amt) >= 1"""))
def generated_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Samples of two metrics of all kinds."""
    from functools import reduce

    from ledgerlens.plans import generate as G

    f = facts_long(spark, d)
    every = reduce(DataFrame.unionByName, [G.combine(f, [("extendedprice", "tax_amt")], kind) for kind in G.PAIRS])
    return every.select("category", F.get("companies", 0).alias("company"), F.get("years", 0).alias("year"), F.round("answer", 6).alias("answer"))


@query(_facts_sql("""SELECT count(DISTINCT company) + 1 AS total_files, count(DISTINCT company) AS files_with_tables, count(DISTINCT company) AS files_with_main, count(DISTINCT company) AS n_tables, count(DISTINCT company) AS n_cdkt,
count(DISTINCT company) AS n_with_unit, 1 AS p50, 1 AS p90, round(count(DISTINCT company) / (count(DISTINCT company) + 1), 9) AS coverage FROM facts"""))
def extraction_summary(spark: SparkSession, d: str) -> DataFrame:
    """The report of an extraction of rendered reports and of one without tables."""
    from ledgerlens.operators import extraction

    texts = reports_of(facts_long(spark, d)).unionByName(spark.createDataFrame([("/data/financial_statements/X/2021/x.txt", "chữ")], "path string, text string"))
    tables = extraction.extract_tables(texts)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(_extracted)?\.txt$", "")
    out = evaluation.extraction_report(texts.select(stem.alias("report_id")), tables)
    return out.select("total_files", "files_with_tables", "files_with_main", "n_tables", "n_cdkt", "n_with_unit", "p50", "p90", F.round("coverage", 9).alias("coverage"))


_CELLS = "SELECT conv_id, turn, '| ' || coalesce(role, '') || ' | ' || coalesce(text, '') || ' |' AS line FROM conversations"


@query(f"SELECT conv_id, '| role | text |' || chr(10) || '| --- | --- |' || chr(10) || string_agg(line, chr(10) ORDER BY turn, line) AS md FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, line) AS r FROM ({_CELLS})) WHERE r <= 15 GROUP BY conv_id")
def table_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as markdown tables of their first rows."""
    from ledgerlens.operators import serialize

    line = F.concat(F.lit("| "), F.coalesce("role", F.lit("")), F.lit(" | "), F.coalesce("text", F.lit("")), F.lit(" |"))
    place = Window.partitionBy("conv_id").orderBy("turn", line)
    first = load(spark, d, "conversations").withColumn("r", F.row_number().over(place)).where("r <= 15")  # the preview's rows, so that a group is bounded
    rows = first.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("r", F.array("role", "text").alias("cells")))).alias("x"))
    return rows.select("conv_id", serialize.markdown(F.transform("x", lambda x: x["cells"]), F.array(F.lit("role"), F.lit("text"))).alias("md"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN lower(p_type) END AS canonical FROM part")
def canonical_terms(spark: SparkSession, d: str) -> DataFrame:
    """Part types with numbering and in capitals, named through the map of normalized labels; half have a name."""
    from ledgerlens.sources import reports

    part = load(spark, d, "part")
    terms = part.select(F.initcap("p_type").alias("raw"), F.lit(None).cast("string").alias("clean"), F.lower("p_type").alias("canonical")).distinct().withColumn("seq", F.lit(0))
    label = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("  "), F.upper("p_type"))).otherwise("no such label")
    return reports.with_canonical(part.select("p_partkey", label.alias("metric_raw")), reports.canonical_map(terms)).select("p_partkey", "canonical")


@query(f"""WITH r AS ({_DOCS}), f AS (SELECT source AS query_id, doc_id, a AS rank FROM r WHERE a <= 20), g AS (SELECT DISTINCT source AS query_id, lang AS intent, doc_id FROM documents WHERE doc_id % 7 = 0),
q AS (SELECT g.query_id, g.intent, count(*) AS n, count(*) FILTER (WHERE f.rank <= 5) AS h5, count(*) FILTER (WHERE f.rank <= 20) AS h20 FROM g LEFT JOIN f ON g.query_id = f.query_id AND g.doc_id = f.doc_id GROUP BY ALL)
SELECT query_id, intent, round(h5 / n, 9) AS recall_5, round(h20 / n, 9) AS recall_20, h20 > 0 AS hit FROM q""")
def retrieval_eval(spark: SparkSession, d: str) -> DataFrame:
    """Recall of each source's longest documents for those with certain ids."""
    docs = load(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    found = docs.select(F.col("source").alias("query_id"), "doc_id", rank.alias("rank")).where("rank <= 20")
    gold = docs.where("doc_id % 7 = 0").select(F.col("source").alias("query_id"), F.col("lang").alias("intent"), "doc_id")
    out = evaluation.retrieval_quality(found, gold)
    return out.select("query_id", "intent", F.round("recall_5", 9).alias("recall_5"), F.round("recall_20", 9).alias("recall_20"), F.coalesce("hit", F.lit(False)).alias("hit"))
