"""Token counts by the whole-token shortcut.

Offline, once, it is proved which vocabulary strings are one pre-token that encodes alone as one token. A pre-token in
that table counts 1 without any merge; only the rest is merged, and its count kept for a while.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); a special string inside a text is one token, as by the
library's default; repeated rows each get a row; an empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Vocabulary
from .common import over_texts, texts_of

#: Merged counts that a task keeps at most; beyond that it starts anew.
KEPT_COUNTS = 400_000


def whole_tokens(path: str) -> frozenset[str]:
    """The vocabulary strings that one split leaves whole and that the merges then bring to one token. Bounded by the vocabulary."""
    vocabulary = Vocabulary.load(path)
    found = set()
    for token in vocabulary.tokens:
        try:
            text = token.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if text and vocabulary.split(text) == [text] and len(vocabulary.merge(token)) == 1:
            found.add(text)
    return frozenset(found)


class Counts(dict):
    """Tokens by pre-token: 1 for whole tokens, merged when first asked for else."""

    def __init__(self, whole: frozenset[str], vocabulary: Vocabulary):
        super().__init__(dict.fromkeys(whole, 1))
        self.whole, self.vocabulary = whole, vocabulary

    def __missing__(self, word: str) -> int:
        n = len(self.vocabulary.encode_piece(word.encode()))
        if len(word) <= 64:
            if len(self) > len(self.whole) + KEPT_COUNTS:
                self.clear()
                self.update(dict.fromkeys(self.whole, 1))
            self[word] = n
        return n


@lru_cache(maxsize=2)
def counts_of(path: str, whole: frozenset[str]) -> Counts:
    return Counts(whole, Vocabulary.load(path))


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every text."""
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))

    def work():
        counts = counts_of(path, whole.value)
        vocabulary = counts.vocabulary
        look, split, special = counts.__getitem__, vocabulary.split, vocabulary.special

        def do(texts: list) -> dict:
            sizes, tokens = [], []
            for text in texts:
                text = text or ""
                sizes.append(len(text.encode()))
                if special in text:
                    parts = text.split(special)
                    tokens.append(len(parts) - 1 + sum(sum(map(look, split(part))) for part in parts))
                else:
                    tokens.append(sum(map(look, split(text))))
            return {"n_bytes": sizes, "n_tokens": tokens}

        return do

    found = over_texts(texts_of(docs), work, "n_bytes long, n_tokens long")
    return found.select("doc_id", "__found.n_bytes", "__found.n_tokens", (F.col("__found.n_tokens") > limit).alias("over_limit"))
