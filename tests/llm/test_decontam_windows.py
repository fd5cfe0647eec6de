"""Decontamination of items without long words, against the distance of every item in every text."""

import random

import numpy as np
import pytest

from ledgerlens.llm import decontam


def least_distances(item, texts):
    """Edits from the item to its nearest passage of each text, all texts at once (texts of one length)."""
    chars = np.array([[ord(c) for c in t] for t in texts])
    row = np.zeros((len(texts), chars.shape[1] + 1), np.int32)
    steps = np.arange(chars.shape[1] + 1)
    for k, c in enumerate(item, 1):
        new = np.minimum(row[:, 1:] + 1, row[:, :-1] + (chars != ord(c)))
        new = np.concatenate([np.full((len(texts), 1), k), new], axis=1)
        row = np.minimum.accumulate(new - steps, axis=1) + steps  # letters of the text left out, from the left
    return row.min(axis=1)


WORDS = {
    "letters": lambda r: "".join(r.choice("abcdefghij") for _ in range(r.randrange(1, 4))),
    "sums": lambda r: r.choice([str(r.randrange(1000)), str(r.randrange(10)), *"+-*/=()"]),
    "syllables": lambda r: r.choice("bdghklmnpqstvx") + r.choice("aeiouâêôơư") + r.choice(["", "", "n", "m", "i"]),
    "one long at the end": lambda r: "".join(r.choice("abcdefghij") for _ in range(r.randrange(1, 4))),
}


@pytest.mark.parametrize("kind", WORDS)
def test_items_of_short_words_are_found_at_the_bound(kind):
    r = random.Random(kind)
    make = lambda n: " ".join(WORDS[kind](r) for _ in range(n))
    items = [make(40) + (" conclusively" if kind.startswith("one long") else "") for _ in range(60)]
    assert all(map(decontam.sparse_windows, items))
    letters = sorted(set("".join(items)))

    def edited(text, edits):
        s = list(text)
        for _ in range(edits):
            at, what = r.randrange(len(s)), r.randrange(3)
            s[at : at + (what != 1)] = [r.choice(letters)] * (what != 2)
        return "".join(s)

    texts = [f"{make(60)} {edited(t, int(len(t) * share))} {make(60)}" for t in items for share in (0, 0.1, 0.2)]
    size = max(map(len, texts))
    texts = [decontam.normal(t).ljust(size, "§") for t in texts]
    want = {(d, i): int(n) for i, t in enumerate(items) for d, n in enumerate(least_distances(t, texts)) if n <= int(0.2 * len(t) + 1e-9)}
    got = {(d, i): n for d, i, n, *_ in decontam.matches(decontam.build_index(list(range(60)), items), texts)}
    assert set(got) <= set(want) and all(want[k] == n for k, n in got.items()) and len(want) >= 150
    whole = {k for k in want if k[0] % 3 == 0 and k[0] // 3 == k[1]}
    assert len(whole) == 60 and whole <= set(got)  # no unchanged copy is lost
    assert len(got) >= 0.95 * len(want), len(got) / len(want)


def test_both_kinds_of_items_in_one_block(spark):
    r = random.Random(2)
    short = " ".join(WORDS["letters"](r) for _ in range(50))
    long = " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(4, 9))) for _ in range(20))
    items = spark.createDataFrame([(1, short), (2, long), (3, "2 + 2 = 4")], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"xx yy {t} zz") for k, t in enumerate((short, long, "so 2 + 2 = 4", "clean text of many words"))], "doc_id long, text string")
    assert {(x.doc_id, x.item_id, x.distance) for x in decontam.contaminated(spark, docs, items).collect()} == {(0, 1, 0), (1, 2, 0), (2, 3, 0)}
    assert [x.doc_id for x in decontam.drop_contaminated(spark, docs, items).collect()] == [3]


def test_a_document_beyond_one_piece(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BATCH", 4000)
    r = random.Random(4)
    make = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8))) for _ in range(n))
    items = [make(30), " ".join(WORDS["letters"](r) for _ in range(50))]
    text = f"{make(700)} {items[0]} {make(120)} {items[1]} {make(900)} {items[0][:-1]}"
    got = [(i, n) for _, i, n, *_ in decontam.matches(decontam.build_index([0, 1], items), [decontam.normal(text)])]
    assert got == [(0, 0), (1, 0)]
