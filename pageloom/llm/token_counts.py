"""Token counts of a byte-level BPE vocabulary by rank-synchronous array merging.

Texts are cut into pre-tokens; the pre-tokens not yet counted lie as ragged numpy arrays of symbols, and in each round
every sequence merges all occurrences of its own lowest-ranked pair at the same time. As a pair that holds a new symbol
always ranks after the pair that made it, this gives the library's tokens. What survives is counted.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import whole

#: How byte-level vocabularies cut text into pre-tokens, and the bytes they write as themselves.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = (range(0x21, 0x7F), range(0xA1, 0xAD), range(0xAE, 0x100))
#: Counts of pre-tokens a worker remembers; beyond it starts anew.
REMEMBERED = 400_000
#: Symbols merged at once, unless a single pre-token is longer.
AT_ONCE = 1 << 20
_NONE = np.iinfo(np.int32).max


class Vocabulary:
    """Merge ranks of a tokenizer file, and counts of pre-tokens seen so far."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        ids = content["model"]["vocab"]
        shown = [b for span in PRINTABLE for b in span]
        others = [b for b in range(256) if b not in set(shown)]
        letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.symbols = np.array([ids[letters[b]] for b in range(256)], dtype=np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in content["model"]["merges"]]
        keys = np.array([(ids[a] << 32) | ids[b] for a, b in pairs], dtype=np.int64)
        made = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made
        special = sorted((t["content"] for t in content["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pieces = regex.compile(PRE_TOKEN).findall
        self.seen: dict[str, int] = {}

    def _ranks(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of the pair that begins at each place; none at the end of a sequence."""
        after = np.minimum(at + 1, len(symbols) - 1)
        pairs = (symbols[at] << 32) | symbols[after]
        found = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        known = (self.keys[found] == pairs) & (owner[at] == owner[after]) & (after > at)
        return np.where(known, self.ranks[found], _NONE).astype(np.int32)

    def merged(self, words: list[bytes]) -> np.ndarray:
        """Number of symbols left of each non-empty word."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        symbols = self.symbols[np.frombuffer(b"".join(words), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        left = sizes.copy()
        rank = self._ranks(symbols, owner, np.arange(len(symbols)))
        while len(symbols) > 1:
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, first)
            length = np.diff(np.r_[first, len(owner)])
            # Sequences without a known pair are done and leave the arrays.
            if (lowest == _NONE).any():
                live = np.repeat(lowest != _NONE, length)
                symbols, owner, rank = symbols[live], owner[live], rank[live]
                length, lowest = length[lowest != _NONE], lowest[lowest != _NONE]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(lowest, length))
            # In a run such as "aaa" the pair is taken at every second place, from the left.
            run_start = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) > 1, at, 0))
            at = at[(at - run_start) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            left -= np.bincount(owner[at], minlength=len(left))
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            # Only pairs that touch a new symbol have another rank now.
            now = at - np.arange(len(at))
            stale = np.r_[now, now[now > 0] - 1]
            rank[stale] = self._ranks(symbols, owner, stale)
        return left

    def _learn(self, words: list[str]) -> None:
        part: list[str] = []
        size = 0
        for word in [*words, ""]:
            if part and (not word or size + len(word) > AT_ONCE):
                self.seen.update(zip(part, self.merged([w.encode() for w in part]).tolist(), strict=True))
                part, size = [], 0
            if word:
                part.append(word)
                size += len(word)

    def counts(self, texts: list[str]) -> list[int]:
        """Number of tokens of each text; their pre-tokens that are new are merged together."""
        totals, pieces = [], []
        for text in texts:
            parts = self.special.split(text) if self.special and self.special.search(text) else [text]
            totals.append(len(parts) - 1)
            pieces.append([w for part in parts for w in self.pieces(part)] if len(parts) > 1 else self.pieces(text))
        new = set().union(*pieces).difference(self.seen)
        if len(self.seen) + len(new) > REMEMBERED:
            self.seen.clear()
            new = set().union(*pieces)
        self._learn(list(new))
        return [n + sum(map(self.seen.__getitem__, own)) for n, own in zip(totals, pieces, strict=True)]


def _portions(texts: Iterable[str]) -> Iterator[list[str]]:
    """Texts in lists of about AT_ONCE characters; a longer text stands alone."""
    part: list[str] = []
    size = 0
    for text in texts:
        if part and size + len(text) > AT_ONCE:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once in each worker."""
    return Vocabulary(path)


def token_counts(
    docs: DataFrame, path: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    path: a byte-level BPE tokenizer file that every executor has. Special strings inside a text are one token each;
    nothing is added, cut or padded. Null texts count as empty: no bytes, no tokens. Repeated rows and null doc_ids
    give rows like any other; an empty table gives none; other columns are ignored.
    """

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = vocabulary(path)
        for batch in batches:
            yield pd.Series([n for part in _portions(batch) for n in words.counts(part)], dtype="int64")

    rows = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"))
    counted = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), count("text").alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
