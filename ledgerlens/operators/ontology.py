"""Mapping raw labels to the ontology (inventory D6, D7, J1, J3, F10, N14, C14): exact first, fuzzy only for the rest.

The score is twice the common subsequence over both lengths, of words in order.
A pair that reaches a cut has lengths within a band and shares a least number of
pairs of neighbouring letters (``shared_pairs``), so two strings meet only if the
rarest few of their letter pairs meet: an index of signatures, joined by key and
then verified. What stays below the cut needs its best score as confidence; there
blocks of terms meet blocks of aliases, and letter counts bound the score, so that few
pairs are compared letter by letter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.fuzzy import ratio, ratio_score
from ledgerlens.functions.text import clean_term, key_of
from ledgerlens.operators.blocks import meeting
from ledgerlens.sources.staging import staged

CUT, REVIEW = 85.0, 0.7
#: Aliases and terms that are compared at once.
ALIAS_BLOCK, TERM_BLOCK = 4_000, 200


def alias_index(aliases: DataFrame) -> DataFrame:
    """Key, canonical of (alias, canonical, seq); of equal keys the last."""
    return aliases.select(key_of(F.col("alias")).alias("key"), "canonical", "seq").groupBy("key").agg(F.max_by("canonical", "seq").alias("canonical"))


def sorted_words(text: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(text, " "), lambda w: w != "")), " ")


def letter_pairs(s: Column) -> Column:
    """Pairs of neighbouring letters of a string, equal ones numbered."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, 2))
    numbered = F.transform(F.array(pairs), lambda own: F.transform(own, lambda g, i: F.concat(g, F.size(F.filter(F.slice(own, 1, i + 1), lambda x: x == g)).cast("string"))))
    return F.when(F.length(s) >= 2, F.get(numbered, 0)).otherwise(F.array().cast("array<string>"))


def shared_pairs(length: Column, cut: float) -> Column:
    """How many letter pairs a string of a length shares at least with any that scores ``cut`` with it.

    With a common subsequence of s out of x and y letters, each letter left out breaks two pairs of its own string, and each
    gap one of the other: x - 1 - 2 (x - s) - (y - s) = 3 s - x - y - 1 are common, and s >= cut (x + y) / 200.
    """
    shortest = F.ceil(length * cut / (200 - cut) - 1e-9)
    return F.ceil((3 * cut / 200 - 1) * (length + shortest) - 1 - 1e-9)


def _signatures(rows: DataFrame, rarity: DataFrame, cut: float) -> DataFrame:
    """name, s, pair: for each string the rarest pairs, so many that one is shared with each string that scores ``cut``."""
    each = rows.select("name", "s", F.explode(letter_pairs(F.col("s"))).alias("pair")).join(rarity, "pair", "left")
    order = Window.partitionBy("name").orderBy(F.coalesce("n", F.lit(0)), "pair")
    n = F.count("*").over(Window.partitionBy("name"))
    ranked = each.withColumn("k", F.row_number().over(order)).withColumn("size", n)
    return ranked.where(F.col("k") <= F.col("size") - shared_pairs(F.length("s"), cut) + 1).select("name", "s", "pair")


def near_pairs(terms: DataFrame, aliases: DataFrame, cut: float = CUT) -> DataFrame:
    """term, alias, score of all pairs of strings (name, s: its words in order) that score ``cut`` or more; a cut of 85 at least."""
    if cut < 85:
        raise ValueError("below 85 short strings needn't share a pair of letters")
    rarity = staged(aliases.select(F.explode(letter_pairs(F.col("s"))).alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "rarity")
    asked = _signatures(terms, rarity, cut).select(F.col("name").alias("term"), F.col("s").alias("a"), "pair")
    own = _signatures(aliases, rarity, cut).select(F.col("name").alias("alias"), F.col("s").alias("b"), "pair")
    x, y = F.length("a"), F.length("b")
    band = (y * (200 - cut) >= x * cut - 1e-6) & (x * (200 - cut) >= y * cut - 1e-6)
    met = asked.join(own, "pair").where(band).select("term", "a", "alias", "b").distinct()
    same = terms.select(F.col("name").alias("term"), F.col("s").alias("a")).join(aliases.select(F.col("name").alias("alias"), F.col("s").alias("b")), F.col("a") == F.col("b"))
    return met.unionByName(same).distinct().withColumn("score", ratio_score("a", "b")).where(F.col("score") >= cut).select("term", "alias", "score")


def best_scores(terms: DataFrame, aliases: DataFrame) -> DataFrame:
    """term, score: of each string (name, s) the best score with any alias, in blocks of both."""
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for own, group in zip(pdf["held"], pdf["asked"]):
                own = [r["s"] for r in own]
                letters = {c: i for i, c in enumerate(sorted(set("".join(own))))}
                lengths, counts = np.array([len(s) for s in own]), np.zeros((len(own), len(letters)), np.int16)
                for k, s in enumerate(own):
                    np.add.at(counts[k], [letters[c] for c in s], 1)
                for r in group:
                    mine = np.zeros(len(letters), np.int16)
                    np.add.at(mine, [letters[c] for c in r["s"] if c in letters], 1)
                    bound = 200.0 * np.minimum(counts, mine).sum(axis=1) / np.maximum(lengths + len(r["s"]), 1)
                    best = 0.0
                    for k in np.argsort(-bound, kind="stable"):
                        if bound[k] <= best:
                            break
                        best = max(best, ratio(r["s"], own[k]))
                    out.append((r["name"], best))
            yield pd.DataFrame(out, columns=["term", "score"])

    met = meeting(terms.select("name", "s"), aliases.select("s"), TERM_BLOCK, ALIAS_BLOCK)
    return met.mapInPandas(compare, "term string, score double").groupBy("term").agg(F.max("score").alias("score"))


def map_terms(terms: DataFrame, index: DataFrame, graded: bool = True) -> DataFrame:
    """Raw, clean, canonical, confidence of each distinct term (raw); of equally near aliases the first by name.

    The confidence of a term without a canonical name is its best score, or 0 if not ``graded``.
    """
    cleaned = terms.select("raw").where("raw is not null").distinct().select("raw", clean_term(F.col("raw")).alias("clean"), key_of(F.col("raw")).alias("key"))
    exact = cleaned.join(index, "key").select("raw", "clean", "canonical", F.lit(1.0).alias("confidence"))
    rest = staged(cleaned.join(index.select("key"), "key", "left_anti"), "inexact")
    named = lambda df: df.select(F.col("key").alias("name")).distinct().withColumn("s", sorted_words(F.col("name")))
    aliases = staged(named(index), "aliases")
    near = near_pairs(named(rest), aliases).groupBy("term").agg(F.min(F.struct((-F.col("score")).alias("down"), "alias")).alias("b"))
    near = staged(near.select(F.col("term").alias("key"), F.col("b.alias").alias("alias"), (-F.col("b.down")).alias("score")), "near")
    names = index.select(F.col("key").alias("alias"), "canonical")
    found = rest.join(near, "key").join(names, "alias").select("raw", "clean", "canonical", (F.col("score") / 100).alias("confidence"))
    far = rest.join(near.select("key"), "key", "left_anti")
    if graded:
        far = far.join(best_scores(named(far), aliases).withColumnRenamed("term", "key"), "key", "left")
    else:
        far = far.withColumn("score", F.lit(0.0))
    far = far.select("raw", "clean", F.lit(None).cast(dict(index.dtypes)["canonical"]).alias("canonical"), (F.coalesce("score", F.lit(0.0)) / 100).alias("confidence"))
    return exact.unionByName(found).unionByName(far)


def attach(facts: DataFrame, mapped: DataFrame) -> DataFrame:
    """Facts with canonical and confidence; labels without a mapping get null and 0."""
    dim = mapped.select(F.col("raw").alias("metric_raw"), "canonical", "confidence")
    return facts.join(dim, "metric_raw", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def split_review(mapped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mapped terms and the review queue; what lies between is in neither."""
    return mapped.where("canonical is not null"), mapped.where(F.col("canonical").isNull() & (F.col("confidence") < REVIEW))
