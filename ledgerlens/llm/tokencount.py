"""Token counts under a unigram model, shared through a trie.

The words of a partition go into a trie. A node is made once, however many words
and documents share the prefix it ends; when it is made, its forward score (the
best log-probability of any segmentation of the prefix into vocabulary pieces)
is computed from the nodes above it, so that a shared prefix is scored once. A
node keeps the number of tokens of its best segmentation; where a word ends the
node stores that terminal count, and a document's count is the sum over its
words. Nothing is shuffled.

A pre-token is a word (between white space) behind the word mark; a character
that no piece covers costs one unknown token with the score of the worst piece
less UNKNOWN_PENALTY. Ties of scores go to fewer tokens. The vocabulary is read
from a public SentencePiece model file, a parameter; a piece's log-probability
follows from its place by Zipf's law, ln(1 / ((place + 1) * H)).

Edge cases: null, empty and blank texts have no tokens. Very long texts are
counted whole. The trie is emptied, also in the middle of a text, when it holds
TRIE_NODES nodes, and a word of more than LONG_WORD characters is scored without
it, keeping only as many forward scores as the longest piece needs; both bound a
task's memory and change no count. Repeated rows each give a row. Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import log

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MARK = "▁"
UNKNOWN_PENALTY = 10.0
TRIE_NODES = 1_200_000
LONG_WORD = 2_000
#: Characters of a prefix's end by which the pieces that may end there are bounded.
TAIL = 3


def zipf_scores(pieces: list[str]) -> dict[str, float]:
    """Log-probabilities of pieces in the order of their frequency."""
    h = log(sum(1 / (i + 1) for i in range(len(pieces))))
    out: dict[str, float] = {}
    for i, p in enumerate(pieces):
        out.setdefault(p, -log(i + 1) - h)
    return out


def sentencepiece_pieces(path: str) -> list[str]:
    """The normal pieces of a SentencePiece model, first the most frequent."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [model.id_to_piece(i) for i in sorted(ids, key=lambda i: (-model.get_score(i), i))]


class Trie(dict):
    """word -> its terminal count. Nodes are numbers; node 0 is the empty prefix."""

    def __init__(self, scores: dict[str, float], most_nodes: int = TRIE_NODES):
        self.scores, self.most_nodes = scores, most_nodes
        self.longest = max(map(len, scores), default=1)
        #: The longest piece that ends in these TAIL characters; shorter pieces are looked for in any case.
        self.tails: dict[str, int] = {}
        for piece in scores:
            tail = piece[-TAIL:]
            self.tails[tail] = max(self.tails.get(tail, 0), len(piece))
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.made = 0
        self.empty()

    def empty(self) -> None:
        self.clear()
        self.children: list[dict[str, int]] = [{}]
        self.best: list[tuple[float, int]] = [(0.0, 0)]  # forward score, minus the number of tokens

    def forward(self, text: str, end: int, before: Callable[[int], tuple[float, int]]) -> tuple[float, int]:
        """The best (score, minus tokens) of the first ``end`` characters, given those of shorter prefixes."""
        score, tokens = before(end - 1)
        top = (score + self.unknown, tokens - 1)
        reach = self.tails.get(text[max(0, end - TAIL) : end], 0)
        for start in range(max(0, end - max(reach, TAIL - 1)), end):
            piece = self.scores.get(text[start:end])
            if piece is not None:
                score, tokens = before(start)
                if (found := (score + piece, tokens - 1)) > top:
                    top = found
        return top

    def __missing__(self, word: str) -> int:
        """The number of tokens of a word; new nodes are made and scored on the way."""
        marked = MARK + word
        if len(marked) > LONG_WORD:
            return self.long(marked)
        if len(self.best) > self.most_nodes:
            self.empty()
        children, best = self.children, self.best
        path, node, end = [0], 0, 0
        for c in marked:
            end += 1
            below = children[node].get(c)
            if below is None:
                break
            node = below
            path.append(node)
        else:
            end += 1
        scores, tails, unknown, made = self.scores, self.tails, self.unknown, len(best)
        # from here on all nodes are new: as ``forward``, in place
        for end in range(end, len(marked) + 1):
            score, tokens = best[node]
            top = (score + unknown, tokens - 1)
            reach = tails.get(marked[end - TAIL : end] if end > TAIL else marked[:end], 0)
            for start in range(max(0, end - (reach if reach >= TAIL else TAIL - 1)), end):
                piece = scores.get(marked[start:end])
                if piece is not None:
                    score, tokens = best[path[start]]
                    if (found := (score + piece, tokens - 1)) > top:
                        top = found
            children[node][marked[end - 1]] = node = len(best)
            best.append(top)
            children.append({})
            path.append(node)
        self.made += len(best) - made
        self[word] = count = -best[node][1]
        return count

    def long(self, marked: str) -> int:
        ring = [(0.0, 0)] * (self.longest + 1)
        before = lambda k: ring[k % len(ring)]
        for end in range(1, len(marked) + 1):
            ring[end % len(ring)] = self.forward(marked, end, before)
        return -before(len(marked))[1]

    def count(self, text: str | None) -> tuple[int, int]:
        """(tokens, words) of a text."""
        words = (text or "").split()
        return sum(map(self.__getitem__, words)), len(words)


def count_tokens(docs: DataFrame, scores: dict[str, float]) -> DataFrame:
    """doc_id, n_tokens, n_words of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(scores)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = Trie(sent.value)
        for pdf in batches:
            counts = [trie.count(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": [c[0] for c in counts], "n_words": [c[1] for c in counts]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(run, "doc_id long, n_tokens long, n_words long")


def public_scores() -> dict[str, float]:
    import public_tokenizers

    return zipf_scores(sentencepiece_pieces(public_tokenizers.path("piece_bpe_32k.model")))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``: doc_id, n_tokens, n_words."""
    return count_tokens(table(spark, sf_dir, "documents"), public_scores())


QUERIES = {"op1_token_counts": op1_token_counts}
ORACLE_SQL: dict[str, str] = {}
