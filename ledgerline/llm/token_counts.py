"""Token counts of a unigram tokenizer without its tokens.

An Aho-Corasick automaton finds every vocabulary piece in a word; a forward pass over the word's places keeps, for each, the
best score that ends there and how many pieces it takes. Ties follow the tokenizer: pieces that end at one place are tried
from the longest on and only a strictly better score replaces another; a character that is no piece of its own may be
unknown at ten below the lowest score; neighbouring unknown characters are one token.
"""

from __future__ import annotations

import math
from functools import cache

import ahocorasick
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import LONGEST, REMEMBERED, tokenizer_path

SPACE = "▁"
UNKNOWN = "<unk>"
UNKNOWN_PENALTY = 10.0
PIECES = "piece_bpe_32k.model"


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Unknown piece first, then the pieces of a sentencepiece file. Its scores are ranks; a piece of rank r gets the log
    probability -log(1 + r) of Zipf's law up to a constant."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))]
    return [(UNKNOWN, 0.0), *((sp.id_to_piece(i), -math.log(1 - sp.get_score(i))) for i in kept)]


class PieceCounter:
    def __init__(self, pieces: list[tuple[str, float]]):
        self.pieces = ahocorasick.Automaton()
        for piece, score in pieces:
            self.pieces.add_word(piece, (len(piece), score))
        self.pieces.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.young: dict[str, tuple[int, int]] = {}
        self.old: dict[str, tuple[int, int]] = {}

    def word(self, word: str) -> tuple[int, int]:
        """Pieces of the best split, and how many of them are unknown."""
        n = len(word)
        score, count, unknown, open_end = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        found = self.pieces.iter(word)
        end, (length, value) = next(found, (n, (0, 0.0)))
        for e in range(1, n + 1):
            best, start, single = -math.inf, e - 1, False
            while end == e - 1:  # the automaton names the longest piece first
                now = score[e - length] + value
                if now > best:
                    best, start = now, e - length
                single = length == 1
                end, (length, value) = next(found, (n, (0, 0.0)))
            lone = not single and score[e - 1] + self.unknown > best
            if lone:
                best, start = score[e - 1] + self.unknown, e - 1
                more = not open_end[start]
                count[e], unknown[e] = count[start] + more, unknown[start] + more
            else:
                count[e], unknown[e] = count[start] + 1, unknown[start]
            score[e], open_end[e] = best, lone
        return count[n], unknown[n]

    def text(self, text: str | None) -> tuple[int, int, int]:
        """Words, pieces and unknown pieces of a text whose words each begin with a space mark."""
        if not text:
            return 0, 0, 0
        marked = text.replace(" ", SPACE)
        words = marked.split(SPACE)
        if marked.startswith(SPACE):
            del words[0]
        for w in set(words).difference(self.young):
            if len(w) <= LONGEST:
                self.young[w] = self.old.get(w) or self.word(SPACE + w)
        get = self.young.get
        counts = [get(w) or self.word(SPACE + w) for w in words]
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        return len(words), sum(c for c, _ in counts), sum(u for _, u in counts)


@cache
def counter(path: str) -> PieceCounter:
    """The counter of this worker process."""
    return PieceCounter(vocabulary(path))


def counted(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_words, n_pieces, n_unknown of every whole text.

    Null and empty texts count zero. Every row counts by itself; repeated rows are counted each. An empty table gives no
    rows. Only doc_id and text are read.
    """
    path = path or tokenizer_path(PIECES)

    def count(texts: pd.Series) -> pd.DataFrame:
        of = counter(path).text
        return pd.DataFrame([of(t) for t in texts], columns=["n_words", "n_pieces", "n_unknown"], dtype="int64")

    kind = T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "n_pieces", "n_unknown")])
    return docs.select(docs["doc_id"].alias("doc_id"), F.pandas_udf(count, kind)(docs["text"].cast("string")).alias("c")).select("doc_id", "c.*")
