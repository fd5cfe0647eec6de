"""Secret scans against a plain version, and held-out random strings and names."""

import hashlib
import random
import re
import string
from itertools import groupby

import pytest

from ledgerlens.llm import secrets

KINDS = ["assign", "access", "hex", "random"]


@pytest.fixture(scope="module")
def scanner():
    return secrets.Scanner(*secrets.public_ranks())


def plain_spans(text, coding):
    base = []
    for m in re.finditer(r"""(?a:(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", text):
        if m.end(2) - m.start(2) >= 8:
            base.append((m.start(), 0, m.end()))
    for kind, pattern, least in ((1, r"AKIA[A-Z0-9]+", 16), (2, r"[0-9a-f]+", 32)):
        base += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if m.end() - m.start() >= least]
    added, at = [], 0
    for inside, part in groupby(text, lambda c: c in string.ascii_letters + string.digits + "+/_=-"):
        run = "".join(part)
        end = at + len(run)
        if inside and len(run) >= 16 and not any(s < end and at < e for s, _, e in base):
            if not secrets.known_form(run) and len(run) / len(coding.encode_ordinary(run)) < secrets.CHARS_A_TOKEN:
                added.append((at, 3, end))
        at = end
    return sorted(base + added)


def sample(rng):
    letters = string.ascii_letters + string.digits
    some = lambda al, n: "".join(rng.choice(al) for _ in range(n))
    pieces = [
        "password = '" + some(letters, rng.randrange(5, 12)) + "'", "API_KEY:" + some(letters, 9), "apikey=x", "token:secret:" + some(letters, 8), "AKIA" + some(string.ascii_uppercase, rng.randrange(9, 16)),
        some("0123456789abcdef", rng.randrange(28, 45)), some(letters, rng.randrange(12, 40)), some(letters, 20) + "/" + some("0123456789abcdef", 33), "plain words", "日本語のテキスト", "max_buffer_size_in_bytes",
        "getUserNameFromToken", "4556-1234-1234-9999", "123e4567-e89b-12d3-a456-426614174000", "ſecret=abcdefghij", "TOKEN=" + some(letters, 30) + "é", "\n", "𝔘", "token=secret=abc", "secret  :  \"abcdefgh\"",
    ]
    return " ".join(rng.choice(pieces) if rng.random() < 0.7 else rng.choice(pieces) + rng.choice(pieces) for _ in range(rng.randrange(0, 25)))


def test_spans_equal_a_plain_version(scanner):
    rng = random.Random(7)
    seen = set()
    for _ in range(1500):
        text = sample(rng)
        got = scanner.spans(text)
        assert got == plain_spans(text, scanner.coding)
        seen |= {k for _, k, _ in got}
    assert seen == {0, 1, 2, 3}


@pytest.mark.parametrize("alphabet", [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_lowercase + string.digits, "0123456789abcdef"])
def test_random_strings_are_found_and_names_are_not(scanner, alphabet):
    rng = random.Random(11)
    drawn = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(20, 31))) for _ in range(1000)]
    assert sum(bool(scanner.spans(x)) for x in drawn) >= 980
    names = ["internationalization", "HTTPSConnectionPoolManager", "src/main/java/com/example/Application", "max_retries_per_connection_2", "2024-01-31/2024-02-29", "4000123412341234",
             "123e4567-e89b-12d3-a456-426614174000", "D41D8CD98F00B204E9800998ECF8427E", "________________________", "================", "well-known-uri-registration"]
    assert [x for x in names if scanner.spans(x)] == []


def test_query_columns_against_plain(spark, tmp_path, scanner):
    rng = random.Random(5)
    rows = [(i, sample(rng)) for i in range(60)] + [(60, None), (61, ""), (None, "token=abcdefgh12"), (3, "again"), (3, "again"), (62, ("word " * 9 + "api_key = 'k3yK3yk3y!' ") * 20000), (63, "aB3" * 100000)]
    spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, spans string, kind int").write.parquet(f"{tmp_path}/documents.parquet")
    got = secrets.op11_secret_scan(spark, str(tmp_path)).collect()
    want = []
    for i, t in rows:
        spans = plain_spans(t or "", scanner.coding)
        joined = lambda own: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in own)
        want.append((i, *(sum(k == n for _, k, _ in spans) for n in range(3)), hashlib.sha256(joined([s for s in spans if s[1] < 3]).encode()).hexdigest(), joined(spans)))
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert secrets.op11_secret_scan(spark, str(tmp_path)).count() == 0
