"""BPE encoding and decoding with a pair occurrence index.

The distinct pre-tokens of a partition's documents lie end to end in one array
of symbols. An index maps each pair of adjacent symbols, by its rank, to all its
positions; a heap holds the ranks that occur. The lowest rank is taken, its
pair is merged at every indexed position from left to right, and the pairs that
arise beside the merged symbols join the index and the heap. Words never share
a pair, so each word sees its own pairs in ascending rank, as if encoded alone.

The vocabulary file (a ``tokenizers`` JSON of kind BPE with a word-end suffix) is
a parameter; its text is read once on the driver and sent to the executors.

Edge cases: a null or empty text has no tokens and decodes to the empty string.
Strings of the vocabulary's special tokens in a text become those tokens, as in
the library. Symbols outside the vocabulary are dropped, as the library does
without an unknown token. Very long texts are encoded whole. No pre-token crosses
white space and no character composes across it, so a text is cut at white space
and each distinct chunk is normalised, split and encoded once; the memory of a task
is bounded by the chunks of TEXTS_AT_ONCE texts, by WORDS_AT_ONCE pre-tokens that are merged
together and by caches that are halved beyond CACHED_CHARS characters. Extra columns
are ignored by the query.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: Characters of chunks, ids and decoded texts that a task keeps, and what an entry counts besides.
CACHED_CHARS, ENTRY_CHARS = 80_000_000, 200
#: Texts that are cut together.
TEXTS_AT_ONCE = 100
#: New distinct pre-tokens that are merged together.
WORDS_AT_ONCE = 20_000
#: Unicode white space as the vocabulary's normalizer sees it.
#: ``str.split`` cuts at these as well, the vocabulary doesn't.
_NOT_SPACE = "\x1c\x1d\x1e\x1f"
_SPACE = "\t-\r" + "".join(map(chr, (0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    kept = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = (b for b in range(256) if b not in set(kept))
    return [chr(c) for _, c in sorted([(b, b) for b in kept] + [(b, 256 + i) for i, b in enumerate(rest)])]


class WordBpe:
    """Encoder and decoder of one vocabulary file, given as its JSON text."""

    def __init__(self, spec: str):
        j = json.loads(spec)
        model = j["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.inner = [vocab.get(s) for s in symbols]
        self.final = [vocab.get(s + suffix) for s in symbols]
        # pairs of vocabulary ids as one number -> rank; rank -> ids of the two and of the whole
        self.rank: dict[int, int] = {}
        self.rules: list[tuple[int, int, int]] = []
        for a, b in model["merges"]:
            if (code := vocab[a] << 32 | vocab[b]) not in self.rank:
                self.rank[code] = len(self.rules)
                self.rules.append((vocab[a], vocab[b], vocab[a + b]))
        #: symbols of single bytes, and the ranks of their pairs, -1 for none
        own = np.array([-1 if i is None else i for i in self.inner + self.final])
        self.single = own
        self.first = np.array([[self.rank.get(x << 32 | y, -1) if x >= 0 and y >= 0 else -1 for y in own.tolist()] for x in own.tolist()], np.int32)
        self.name = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.name.update({i: t for t, i in self.special.items()})
        pattern = j["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(pattern).findall
        self.spaces = regex.compile(f"[{_SPACE}]+")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        #: chunk -> (decimal ids joined by one space, decoded text, number of tokens)
        self.known: dict[str, tuple[str, str, int]] = {}
        self.kept = 0
        self.numeral = [str(i) for i in range(max(self.name) + 1)]

    def chunks(self, text: str) -> list[str]:
        """What stands between white space, and special tokens, in order."""
        parts = self.cut.split(text) if any(s in text for s in self.special) else [text]
        out: list[str] = []
        for part in parts:
            if part in self.special:
                out.append(part)
            elif any(c in part for c in _NOT_SPACE):
                out += filter(None, self.spaces.split(part))
            else:
                out += part.split()
        return out

    def pre_tokens(self, chunk: str) -> list[str]:
        """Pre-tokens of a chunk in order."""
        if chunk.isascii():
            plain = chunk.lower()
        else:  # the library lower-cases each character by itself
            plain = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        return [plain] if plain.isalpha() else self.find(plain)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of each distinct pre-token, by the pair occurrence index."""
        raw = [w.encode("utf-8", "replace") for w in words]
        place = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(lengths)
        place[ends[lengths > 0] - 1] += 256
        word = np.repeat(np.arange(len(raw)), lengths)
        there = self.single[place] >= 0
        place, word = place[there], word[there]
        n = len(place)
        bounds = np.searchsorted(word, np.arange(len(raw) + 1)).tolist()
        # the index of all pairs that have a rank, in ascending order of rank and place
        rank = np.where(word[:-1] == word[1:], self.first[place[:-1], place[1:]], -1)
        where = np.flatnonzero(rank >= 0)
        where = where[np.argsort(rank[where], kind="stable")]
        ranks, cuts = np.unique(rank[where], return_index=True)
        where, ranks, cuts = where.tolist(), ranks.tolist(), [*cuts.tolist(), len(where)]
        at = {r: where[a:b] for r, a, b in zip(ranks, cuts, cuts[1:])}
        sym = self.single[place].tolist()
        following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
        for b in bounds:
            if b:
                following[b - 1] = -1
            if b < n:
                previous[b] = -1
        find, rules, push, pop = self.rank.get, self.rules, heapq.heappush, heapq.heappop
        while ranks:  # ascending, so a heap
            rank = pop(ranks)
            left, right, new = rules[rank]
            places = at.pop(rank)
            if len(places) > 1:
                places.sort()
            for p in places:
                q = following[p] if sym[p] == left else -1
                if q < 0 or sym[q] != right:
                    continue  # merged into another symbol since
                sym[p], sym[q] = new, -1
                r, o = following[q], previous[p]
                following[p] = r
                if r >= 0:
                    previous[r] = p
                    if (k := find(new << 32 | sym[r])) is not None:
                        if k in at:
                            at[k].append(p)
                        else:
                            at[k] = [p]
                            push(ranks, k)
                if o >= 0 and (k := find(sym[o] << 32 | new)) is not None:
                    if k in at:
                        at[k].append(o)
                    else:
                        at[k] = [o]
                        push(ranks, k)
        return [[s for s in sym[a:b] if s >= 0] for a, b in zip(bounds, bounds[1:])]

    def learn(self, chunks: Iterable[str]) -> None:
        """Put chunks that are not yet known, and their pre-tokens, in the cache."""
        known, cut, new = self.known, {}, {}
        for chunk in chunks:
            if chunk in self.special:
                known[chunk] = str(self.special[chunk]), chunk, 1
                continue
            words = self.pre_tokens(chunk)
            if len(words) != 1 or words[0] != chunk:
                cut[chunk] = words
            for w in words:  # a pre-token by itself is cut as it was inside its chunk
                if w not in known:
                    new[w] = None
        new = list(new)
        for i in range(0, len(new), WORDS_AT_ONCE):
            part = new[i : i + WORDS_AT_ONCE]
            for word, ids in zip(part, self.encode_words(part)):
                known[word] = found = " ".join([self.numeral[i] for i in ids]), self.decode(ids), len(ids)
                self.kept += len(found[0]) + len(found[1]) + ENTRY_CHARS
        for chunk, words in cut.items():
            if len(words) == 1:
                known[chunk] = known[words[0]]
            else:
                found = [f for f in map(known.__getitem__, words) if f[2]]
                known[chunk] = " ".join([f[0] for f in found]), " ".join([f[1] for f in found]), sum([f[2] for f in found])
            self.kept += len(chunk) + ENTRY_CHARS

    def shrink(self) -> None:
        """Keep the earlier half of the cache: what is frequent was met early."""
        self.known = dict(islice(self.known.items(), len(self.known) // 2))
        self.kept //= 2

    def decode(self, ids: list[int]) -> str:
        """As the library decodes without a decoder: the tokens' names joined by one space."""
        return " ".join([self.name[i] for i in ids])

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for ids, _, _ in self.rows([text]) for i in ids.split()]

    def rows(self, texts: list[str | None]) -> Iterator[tuple[str, str, int]]:
        """(decimal ids joined by one space, decoded text, number of tokens) of each text."""
        for i in range(0, len(texts), TEXTS_AT_ONCE):
            cut = [self.chunks(t or "") for t in texts[i : i + TEXTS_AT_ONCE]]
            known = self.known
            found = [list(map(known.get, chunks)) for chunks in cut]
            some = [None in f for f in found]
            if any(some):
                self.learn({c: None for chunks, new in zip(cut, some) if new for c in chunks if c not in known})
            for chunks, own, new in zip(cut, found, some):
                own = list(map(known.__getitem__, chunks)) if new else own
                ids, names, counts = zip(*own) if own else ((), (), ())
                if 0 in counts:
                    ids, names = filter(None, ids), [x for x, n in zip(names, counts) if n]
                yield " ".join(ids), " ".join(names), sum(counts)
            if self.kept > CACHED_CHARS:
                self.shrink()


@lru_cache(maxsize=2)
def _coder(spec: str) -> WordBpe:
    return WordBpe(spec)


def encode_documents(docs: DataFrame, spec: str, digests: bool = True) -> DataFrame:
    """Per document doc_id, n_tokens and ids and decoded text, or (``digests``) their SHA-256."""
    sent = docs.sparkSession.sparkContext.broadcast(spec)
    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = _coder(sent.value)
        for pdf in batches:
            n, a, b = [], [], []
            for ids, text, count in coder.rows(list(pdf["text"])):
                n.append(count)
                a.append(hashlib.sha256(ids.encode()).hexdigest() if digests else ids)
                b.append(hashlib.sha256(text.encode()).hexdigest() if digests else text)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": n, names[0]: a, names[1]: b})

    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), *(T.StructField(c, T.StringType()) for c in names)]
    )
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, schema)


def public_vocabulary() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode_documents(table(spark, sf_dir, "documents"), public_vocabulary())


QUERIES = {"op10_bpe": op10_bpe}
ORACLE_SQL: dict[str, str] = {}
