"""The fuzzy join against all scores, on misspelt terms."""

import random

import pytest

from ledgerlens.functions.fuzzy import ratio, token_sort_ratio
from ledgerlens.functions import text
from ledgerlens.operators import ontology
from ledgerlens.sources import reports

SYLLABLES = ["doanh", "thu", "chi", "phi", "loi", "nhuan", "tai", "san", "no", "phai", "tra", "von", "gop", "tien", "mat", "thue", "lai", "vay", "co", "phieu", "hang", "ton", "kho", "ban"]


def _misspelt(rng, s):
    words = s.split()
    rng.shuffle(words)
    s = " ".join(words)
    for _ in range(rng.randrange(0, 5)):
        at = rng.randrange(len(s) + 1)
        s = rng.choice([s[:at] + s[at + 1 :], s[:at] + rng.choice("aeiounhtc ") + s[at:], s[: at - 1] + s[at : at + 1] + s[max(at - 1, 0) : at] + s[at + 1 :] if at else s])
    return s


def test_five_thousand_misspelt_terms(spark):
    rng = random.Random(2)
    aliases = sorted({" ".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 6))) for _ in range(200)})
    terms = sorted({_misspelt(rng, rng.choice(aliases)) for _ in range(6000)} | {"zq", "x", "a b", "  ", "nothing like it at all", "tien tien tien tien"})[:5200]
    assert len(terms) > 4500
    index = ontology.alias_index(spark.createDataFrame([(a, f"C-{a}", k) for k, a in enumerate(aliases)], "alias string, canonical string, seq int"))
    got = {r.raw: (r.canonical, r.confidence) for r in ontology.map_terms(spark.createDataFrame([(t,) for t in terms] + [(None,), (terms[0],)], "raw string"), index).collect()}
    keys = {r.key for r in index.collect()}
    named = {t: k for t, k in ((r.raw, r.key) for r in spark.createDataFrame([(t,) for t in terms], "raw string").select("raw", ontology.key_of(ontology.F.col("raw")).alias("key")).collect())}
    fuzzy = 0
    for t in terms:
        k = named[t]
        if k in keys:
            want = (f"C-{k}", 1.0)
        else:
            near = max(aliases, key=lambda a: token_sort_ratio(k, a))  # the first of the best: aliases are sorted
            score = token_sort_ratio(k, near)
            want = (f"C-{near}" if score >= 85 else None, score / 100)
            fuzzy += score >= 85
        assert got[t][0] == want[0] and got[t][1] == pytest.approx(want[1]), (t, got[t], want)
    assert set(got) == set(terms) and fuzzy > 1000


@pytest.mark.parametrize("cut", [85.0, 88.0, 95.0])
def test_no_pair_above_the_cut_is_lost(spark, cut):
    rng = random.Random(int(cut))
    one = sorted({"".join(rng.choice("ab ") for _ in range(rng.randrange(1, 14))).strip() or "a" for _ in range(150)} | {"é" * 9, "日本語", "日本"})
    two = sorted({"".join(rng.choice("ab ") for _ in range(rng.randrange(1, 14))).strip() or "b" for _ in range(150)} | {"é" * 8, "日本語の"})
    word = lambda s: " ".join(sorted(s.split()))
    frame = lambda names: spark.createDataFrame([(n,) for n in names], "name string").withColumn("s", ontology.sorted_words(ontology.F.col("name")))
    got = {(r.term, r.alias) for r in ontology.near_pairs(frame(one), frame(two), cut).collect()}
    assert got == {(a, b) for a in one for b in two if ratio(word(a), word(b)) >= cut} and len(got) > 20


def test_terms_and_aliases_that_are_not_there(spark):
    index = spark.createDataFrame([], "key string, canonical string")
    some = spark.createDataFrame([("tien",)], "raw string")
    assert [tuple(r) for r in ontology.map_terms(some, index).collect()] == [("tien", "tien", None, 0.0)]
    full = spark.createDataFrame([("tien mat", "T")], "key string, canonical string")
    assert ontology.map_terms(some.where("false"), full).count() == 0
    assert [tuple(r) for r in ontology.map_terms(some, full, graded=False).collect()] == [("tien", "tien", None, 0.0)]


def test_review_takes_what_is_far_from_all_names(spark):
    rows = [("a", "a", "A", 1.0), ("b", "b", None, 0.65), ("c", "c", None, 0.75), ("d", "d", "D", 0.9)]
    named, review = ontology.split_review(spark.createDataFrame(rows, "raw string, clean string, canonical string, confidence double"))
    assert sorted(r.raw for r in named.collect()) == ["a", "d"] and [r.raw for r in review.collect()] == ["b"]


def test_of_repeated_keys_the_last_stays(spark):
    rows = spark.createDataFrame([("x", 1, "old"), ("x", 3, "new"), ("x", 2, "mid"), ("y", 1, None)], "k string, seq int, v string")
    assert {(r.k, r.seq, r.v) for r in reports.last_by_key(rows, "k", "seq").collect()} == {("x", 3, "new"), ("y", 1, None)}


def test_a_period_has_all_its_years(spark):
    rows = [("Trong giai đoạn 2018 đến 2021", [2018, 2021]), ("Năm 2018 và 2021", [2018, 2021]), ("Giai đoạn 2020", [2020]), (None, [2019])]
    got = spark.createDataFrame(rows, "q string, y array<int>").select(text.fill_years(ontology.F.col("q"), ontology.F.col("y"))).collect()
    assert [r[0] for r in got] == [[2018, 2019, 2020, 2021], [2018, 2021], [2020], [2019]]
