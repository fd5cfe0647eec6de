"""Secret scans: three patterns, and strings that a tokenizer's vocabulary fits badly.

Base spans come from patterns: an assignment to a name such as password or token
(value of 8 characters or more), an access key, a long run of hex digits. The
token-efficiency test adds the others: what people write merges into long tokens,
a random string breaks into short ones. So each run of at least LEAST letters,
digits and ``+/_=-`` that lies in no base span is encoded under a tiktoken
vocabulary, and it is a span of kind ``random`` where it has fewer than
CHARS_A_TOKEN characters a token. Known digests (hex digits in the lengths of
common hash functions) and identifiers (UUIDs, numbers, names made of words in
one or in camel case, numbered or not, joined by ``-_/+=``) are excluded first.

Rows are independent: no shuffle, no group. Texts are scanned whole; a run is
encoded once in a task as long as the cache has room. The vocabulary is the text
of a tiktoken rank file, bounded (it is a parameter), and sent to the executors.

Spans are in code points, end exclusive, by start and then by kind in the order
of KINDS. Edge cases: a null or empty text has no spans; repeated rows and rows
without doc_id are answered each; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("assign", "access", "hex", "random")
# The patterns of the base spans.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # a shorter match holds no longer one, so the length may stand in the pattern
HEX = re.compile(r"[0-9a-f]{32,}")
VALUE = 8

LEAST, CHARS_A_TOKEN = 16, 2.4
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
DIGEST_SIZES = {32, 40, 48, 56, 64, 96, 128}
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
NUMBER = re.compile(r"[0-9+/_=-]+")
NAME = re.compile(r"[-_/+=]*(?:[A-Za-z]+[0-9]{0,4}|[0-9]{1,8})(?:[-_/+=]+(?:[A-Za-z]+[0-9]{0,4}|[0-9]{1,8}))*[-_/+=]*")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Letters of a name's words on average; random letters change case more often.
WORD_LETTERS = 3
CACHED = 1 << 16


def known_form(run: str) -> bool:
    """Whether a run is a digest or an identifier."""
    if NUMBER.fullmatch(run) or UUID.fullmatch(run) or (len(run) in DIGEST_SIZES and DIGEST.fullmatch(run)):
        return True
    if not NAME.fullmatch(run):
        return False
    words = WORD.findall(run)
    return sum(map(len, words)) >= WORD_LETTERS * len(words)


class Scanner:
    """Spans of texts under one vocabulary, given as the text of a tiktoken rank file and its pattern."""

    def __init__(self, ranks: bytes, pattern: str):
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        self.coding = tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.judged = lru_cache(maxsize=CACHED)(self.judge)

    def judge(self, run: str) -> bool:
        return not known_form(run) and len(run) < CHARS_A_TOKEN * len(self.coding.encode_ordinary(run))

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, place of the kind in KINDS, end), sorted."""
        found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= VALUE] if "=" in text or ":" in text else []
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        found.sort()
        ends, added = 0, []
        at = 0  # base spans that start before the run's end
        for m in RUN.finditer(text):
            while at < len(found) and found[at][0] < m.end():
                ends = max(ends, found[at][2])
                at += 1
            if ends <= m.start() and (self.judged if len(m[0]) < 200 else self.judge)(m[0]):
                added.append((m.start(), 3, m.end()))
        return sorted(found + added) if added else found


@lru_cache(maxsize=2)
def _scanner(ranks: bytes, pattern: str) -> Scanner:
    return Scanner(ranks, pattern)


def find_secrets(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """doc_id and spans (array of kind, start, end) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(*sent.value)
        for batch in batches:
            flat, places = [], [0]
            for text in batch.column(1):
                flat += scanner.spans(text.as_py() or "")
                places.append(len(flat))
            starts, kinds, ends = zip(*flat) if flat else ((), (), ())
            parts = [pa.array([KINDS[k] for k in kinds], pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())]
            spans = pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.StructArray.from_arrays(parts, ["kind", "start", "end"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), spans], ["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def public_ranks() -> tuple[bytes, str]:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``: counts of the base kinds, the digest of base spans, all spans."""
    found = find_secrets(table(spark, sf_dir, "documents"), *public_ranks())
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != KINDS[-1])
    return found.select("doc_id", *map(count, KINDS[:-1]), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES = {"op11_secret_scan": op11_secret_scan}
ORACLE_SQL: dict[str, str] = {}
