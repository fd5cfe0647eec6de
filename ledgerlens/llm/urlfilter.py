"""URL filters: exact membership by a Bloom filter cascade.

Lists hold keys: a host suffix followed by a path prefix, as in ``net/es/``. A
url's own keys are each suffix of its host (by labels) with the path's prefix of
each length that the lists use. All keys of the corpus are the universe. Level 1
of a cascade is a Bloom filter of the listed keys; level 2 holds the unlisted
keys of the universe that pass level 1; level 3 the listed keys of the universe
that pass level 2, and so on until a level lets none through by mistake. A key
of the universe is then listed or not, exactly, without a join.

The false positives of level 1 are gathered on the driver. Its error rate is set
from the counted universe so that about max(listed keys, LEAST) are expected, so
every level, and what is broadcast, is bounded by the lists and not by the corpus.

Edge cases: a null url, or one without ``://``, has no keys and is allowed. Equal
urls are judged alike. An empty table, or empty lists, allow everything; a key
on both lists blocks. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LEAST = 1000
INNER_RATE = 0.5
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
#: Sites that are blocked where no rule fits, a fixed list (a parameter of ``judge``).
SITES = [
    f"{name}.example.{top}"
    for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
    for top in ("com", "net", "org")
]


@dataclass
class Bloom:
    bits: np.ndarray
    size: int
    hashes: int
    level: int

    @classmethod
    def of(cls, keys: Iterable[str], rate: float, level: int) -> Bloom:
        keys = list(keys)
        size = max(64, ceil(-len(keys) * log(rate) / log(2) ** 2))
        made = cls(np.zeros(-(-size // 8), np.uint8), size, max(1, round(size / max(1, len(keys)) * log(2))) if len(keys) else 1, level)
        made.hashes = min(made.hashes, 30)
        for key in keys:
            for b in made.places(key):
                made.bits[b >> 3] |= 1 << (b & 7)
        return made

    def places(self, key: str) -> list[int]:
        h = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass"), self.level)
        a, b = h >> 64, (h & ((1 << 64) - 1)) | 1
        return [(a + i * b) % self.size for i in range(self.hashes)]

    def __contains__(self, key: str) -> bool:
        return all(self.bits[b >> 3] >> (b & 7) & 1 for b in self.places(key))


@dataclass
class Cascade:
    levels: list[Bloom]

    def __contains__(self, key: str) -> bool:
        for n, level in enumerate(self.levels):
            if key not in level:
                return n % 2 == 1
        return len(self.levels) % 2 == 1

    @classmethod
    def build(cls, first: Bloom, listed: set[str], passed: set[str]) -> Cascade:
        """``passed``: the keys of the universe that pass ``first``."""
        levels, inside, outside = [first], passed & listed, passed - listed
        while outside:
            levels.append(Bloom.of(outside, INNER_RATE, len(levels)))
            outside, inside = {k for k in inside if k in levels[-1]}, outside
        return cls(levels)


def host_of(url: Column) -> Column:
    rest = _rest(url)
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    rest = _rest(url)
    return F.regexp_extract(F.regexp_replace(rest, "^[^/?#]*", ""), "^[^?#]*", 0)


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")


def keys_of(host: str, path: str, lengths: list[int]) -> list[str]:
    if not host:
        return []
    labels = host.split(".")
    return [".".join(labels[i:]) + path[:n] for i in range(len(labels)) for n in lengths if n <= len(path)]


def path_lengths(keys: Iterable[str]) -> list[int]:
    return sorted({len(k) - k.index("/") if "/" in k else 0 for k in keys})


def cascades(spark: SparkSession, parts: DataFrame, lists: dict[str, list[str]]) -> dict[str, Cascade]:
    """A cascade for each list over the complete keys of ``parts`` (host, path)."""
    lengths = path_lengths(k for keys in lists.values() for k in keys)
    listed = {name: set(keys) for name, keys in lists.items()}

    def all_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = set().union(*map(lambda h, p: keys_of(h, p, lengths), pdf["host"], pdf["path"])) if len(pdf) else set()
            yield pd.DataFrame({"key": sorted(found)}, dtype=object)

    universe = parts.mapInPandas(all_keys, "key string")
    count = universe.agg(F.approx_count_distinct("key", 0.02)).first()[0] or 0
    firsts = {
        name: Bloom.of(keys, min(0.5, max(len(keys), LEAST) / max(2 * LEAST, len(lists) * count)), 0) for name, keys in listed.items()
    }
    sent = spark.sparkContext.broadcast(firsts)

    def passing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(name, k) for k in pdf["key"] for name, bloom in sent.value.items() if k in bloom]
            yield pd.DataFrame(rows, columns=["name", "key"], dtype=object)

    passed: dict[str, set[str]] = {name: set() for name in lists}
    for r in universe.mapInPandas(passing, "name string, key string").distinct().collect():
        passed[r.name].add(r.key)
    return {name: Cascade.build(firsts[name], listed[name], passed[name]) for name in lists}


def judge(
    spark: SparkSession, pages: DataFrame, rules: list[tuple[str, str]] = RULES, sites: list[str] = SITES
) -> DataFrame:
    """page_id, host, path, rule, verdict: the longest rule that fits, else whether a site key is listed."""
    lists = {v: [k for w, k in rules if w == v] for v in ("allow", "block")} | {"site": list(sites)}
    parts = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url")).select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    made = spark.sparkContext.broadcast(cascades(spark, parts.select("host", "path"), lists))
    lengths = path_lengths(k for keys in lists.values() for k in keys)

    def verdicts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = made.value
        for pdf in batches:
            rule, verdict = [], []
            for host, path in zip(pdf["host"], pdf["path"]):
                keys = keys_of(host, path, lengths)
                fits = [(len(k), len(k.split("/", 1)[0]), v, k) for k in keys for v in ("allow", "block") if k in own[v]]
                best = max(fits, default=None)
                rule.append(best[3] if best else None)
                verdict.append(best[2] if best else "block" if any(k in own["site"] for k in keys) else "allow")
            yield pdf.assign(rule=rule, verdict=verdict)

    kind = dict(parts.dtypes)["page_id"]
    return parts.mapInPandas(verdicts, f"page_id {kind}, host string, path string, rule string, verdict string")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``pages``: page_id, host, path, rule, verdict."""
    return judge(spark, table(spark, sf_dir, "pages"))


def _sql() -> str:
    fits = " UNION ALL ".join(
        f"SELECT '{k}' AS rule, '{v}' AS verdict, '{k.split('/', 1)[0]}' AS rh, '/{k.split('/', 1)[1]}' AS rp" for v, k in RULES
    )
    sites = ", ".join(f"'{s}'" for s in SITES)
    return f"""
WITH rules AS ({fits}), sites AS (SELECT unnest([{sites}]) AS site),
u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host,
             regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
b AS (SELECT p.page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
      FROM p JOIN rules ON (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp) GROUP BY p.page_id),
s AS (SELECT DISTINCT page_id FROM p JOIN sites ON host = site OR suffix(host, '.' || site))
SELECT p.page_id, host, path, b.rule,
       coalesce(b.verdict, CASE WHEN s.page_id IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM p LEFT JOIN b ON p.page_id = b.page_id LEFT JOIN s ON p.page_id = s.page_id"""


QUERIES = {"op9_url_filter": op9_url_filter}
ORACLE_SQL = {"op9_url_filter": _sql()}
