"""Toxicity by weak supervision.

Voters are lexicon entries (words) and patterns (word beginnings, and how many words share them) that the learnable labels make suspicious; each says
"toxic" where it matches, and one more says "clean" where none does. A generative label model estimates, from the votes
alone, how often each voter speaks in either class and which voters speak together beyond that; correlated voters
share their weight. A linear classifier is then trained on the model's posterior labels and scores every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import remainder, whole, written
from pageloom.llm.quality import labelled

#: Labelled rows that are learned from at most: those with the smallest hashes of their ids.
SAMPLE = 6000
#: Lengths of word beginnings that may become patterns; a pattern matches words that are longer.
BEGINNINGS = (3, 4, 5, 6)
#: A voter is seen in so many toxic rows at least, and its smoothed log-odds are so high.
SUPPORT, ODDS = 3, 2.5
#: Voters at most; and terms at most, by weight of evidence, that voters are chosen from and the classifier reads.
VOTERS, TERMS = 300, 1500
#: A toxic row of the sample is to be met by so many voters; a match in a clean row outweighs so many toxic ones.
COVER, PENALTY = 3, 3
ROUNDS = 25
#: Correlation inside the classes from which voters count as dependent.
SAME = 0.3
#: Words whose features a worker remembers.
REMEMBERED = 300_000
_WORD = regex.compile(r"\p{L}+").findall


def patterns(beginning: str, n: int, words: int) -> list[str]:
    """What n of a text's different words that share a beginning show: one, two or more, at least one in a hundred."""
    own = [beginning + "*"]
    if n >= 2:
        own.append(beginning + "*2")
        if n * 100 >= words:
            own.append(beginning + "*%")
    return own


def suspicious(rows: DataFrame) -> tuple[list[str], int]:
    """Terms by evidence for label 1 in the sample, at most TERMS; and how many, from the first, may vote."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    texts = rows.select("labelled", "y", words.alias("ws"))
    pairs = texts.select("labelled", "y", F.size("ws").alias("size"), F.explode("ws").alias("w"))
    starts = F.array_compact(F.array(*[F.when(F.length("w") > n, F.substring("w", 1, n)) for n in BEGINNINGS]))
    begun = (
        pairs.select("labelled", "y", "size", F.explode(starts).alias("b"))
        .groupBy("labelled", "y", "size", "b")
        .agg(F.count("*").alias("k"))
    )
    shown = F.array_compact(
        F.array(
            F.concat("b", F.lit("*")),
            F.when(F.col("k") >= 2, F.concat("b", F.lit("*2"))),
            F.when((F.col("k") >= 2) & (F.col("k") * 100 >= F.col("size")), F.concat("b", F.lit("*%"))),
        )
    )
    seen = pairs.select("labelled", "y", F.col("w").alias("term")).unionByName(
        begun.select("labelled", "y", F.explode(shown).alias("term"))
    )
    totals = rows.agg(F.sum("y").alias("toxic"), F.count("*").alias("n"))
    counts = seen.groupBy("term").agg(F.sum("y").alias("a"), F.count("*").alias("c")).where(F.col("a") >= SUPPORT)
    odds = F.log(
        ((F.col("a") + 0.5) / (F.col("toxic") + 1)) / ((F.col("c") - F.col("a") + 0.5) / (F.col("n") - F.col("toxic") + 1))
    )
    found = counts.crossJoin(F.broadcast(totals)).withColumn("odds", odds).where(F.col("odds") >= 1.0)  # one row
    best = found.orderBy(F.desc(F.col("odds") * F.col("a")), "term").limit(TERMS).select("term", "odds").collect()
    strong = [r["term"] for r in best if r["odds"] >= ODDS]
    return strong + [r["term"] for r in best if r["odds"] < ODDS], len(strong)


class Matcher:
    """Which of the terms occur in a text."""

    def __init__(self, known: list[str]) -> None:
        self.place = {t: i for i, t in enumerate(known)}
        self.beginnings = {t[: t.index("*")] for t in known if "*" in t}
        self.seen: dict[str, tuple[int | None, list[str]]] = {}

    def _of(self, word: str) -> tuple[int | None, list[str]]:
        own = [word[:n] for n in BEGINNINGS if len(word) > n and word[:n] in self.beginnings]
        if len(self.seen) >= REMEMBERED:
            self.seen.clear()
        self.seen[word] = found = (self.place.get(word), own)
        return found

    def __call__(self, text: str) -> np.ndarray:
        found: set[int] = set()
        counts: dict[str, int] = {}
        words = set(_WORD(text.lower()))
        for word in words:
            entry, own = self.seen.get(word) or self._of(word)
            if entry is not None:
                found.add(entry)
            for b in own:
                counts[b] = counts.get(b, 0) + 1
        for b, n in counts.items():
            found.update(self.place[t] for t in patterns(b, n, len(words)) if t in self.place)
        return np.array(sorted(found), dtype=np.int32)


def chosen(x: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Places of the terms that vote: each in turn meets the most toxic rows that few voters meet so far.

    Terms that only some copies of one text share meet no row that is still open, and are not taken.
    """
    hits, misses = x[toxic], x[~toxic].sum(axis=0)
    open_ = np.full(len(hits), COVER)
    left, taken = np.ones(x.shape[1], dtype=bool), []
    while len(taken) < VOTERS:
        gain = np.where(left, (open_ > 0).astype(np.float32) @ hits - PENALTY * misses, -1)
        best = int(gain.argmax()) if len(gain) else 0
        if not len(gain) or gain[best] < SUPPORT:
            break
        taken.append(best)
        # A term that meets almost the same rows would say the same again.
        both = hits[:, best] @ hits
        left &= both < 0.9 * np.maximum(hits.sum(axis=0), hits[:, best].sum())
        left[best] = False
        open_ -= hits[:, best].astype(int)
    return np.array(taken, dtype=np.int64)


def label_model(votes: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of "toxic" per row, per voter the rates of speaking in the clean and the toxic class, and weights.

    votes: rows by voters, 1 where a voter speaks. Expectation maximisation, begun from "two voters or more speak";
    a voter's weight falls with its correlation to other voters inside the classes (they say the same thing twice).
    """
    n, m = votes.shape
    # The last voter speaks where no other does, and says "clean".
    votes = np.c_[votes, votes.sum(axis=1) == 0].astype(np.float64)
    loud = votes[:, :m].sum(axis=1)
    posterior = np.where(loud >= 2, 0.95, np.where(loud == 1, 0.5, 0.02))
    weight = np.ones(m + 1)
    rates = np.zeros((2, m + 1))
    for _ in range(ROUNDS):
        mass = np.stack([1 - posterior, posterior])
        rates = (mass @ votes + np.array([[0.1], [0.5]])) / (mass.sum(axis=1, keepdims=True) + 1.0)
        rates = np.clip(rates, 1e-4, 1 - 1e-4)
        # Voters stay voters for their own side.
        rates[1, :m] = np.maximum(rates[1, :m], 2 * rates[0, :m])
        rates[0, m] = max(rates[0, m], 2 * min(rates[1, m], 0.5 - 1e-4))
        rest = votes - (posterior[:, None] * rates[1] + (1 - posterior)[:, None] * rates[0])
        spread = np.sqrt((rest**2).mean(axis=0)) + 1e-9
        together = np.clip((rest.T @ rest) / n / np.outer(spread, spread), 0, 1)
        np.fill_diagonal(together, 0)
        # Below SAME, speaking together is what voters of one kind of text do, not one voice twice.
        weight = 1 / (1 + (np.clip(together - SAME, 0, 1) / (1 - SAME)).sum(axis=1))
        weight[m] = 1.0
        spoken, silent = np.log(rates[1] / rates[0]), np.log((1 - rates[1]) / (1 - rates[0]))
        logit = np.log(prior / (1 - prior)) + votes @ (weight * spoken) + (1 - votes) @ (weight * silent * 0.1)
        posterior = 1 / (1 + np.exp(-np.clip(logit, -12, 12)))
    return posterior, rates, weight


class Model:
    """A linear classifier on the terms, trained on the label model's posteriors."""

    def __init__(self, known: list[str], strong: int, rows: list[tuple[np.ndarray, int]]) -> None:
        self.known = known
        toxic = sum(y for _, y in rows)
        self.prior = min(max((toxic + 0.5) / (len(rows) + 1.0), 0.01), 0.99)
        self.weights, self.bias = np.zeros(len(known)), float(np.log(self.prior / (1 - self.prior)))
        if not strong:
            return
        x = np.zeros((len(rows), len(known)), dtype=np.float32)
        for i, (found, _) in enumerate(rows):
            x[i, found] = 1
        voters = chosen(x[:, :strong], np.array([y == 1 for _, y in rows]))
        if not len(voters):
            return
        self.voters = [known[i] for i in voters]
        self.posterior, self.rates, self.voter_weights = label_model(x[:, voters], self.prior)
        target, rate = self.posterior.astype(np.float32), 0.5
        w, b = np.zeros(len(known), dtype=np.float32), np.float32(self.bias)
        grad_w, grad_b = np.zeros_like(w), 0.0
        for _ in range(400):  # gradient descent with steps scaled by past gradients
            p = 1 / (1 + np.exp(-(x @ w + b)))
            error = (p - target) / len(rows)
            step_w, step_b = x.T @ error + 1e-4 * w, float(error.sum())
            grad_w += step_w**2
            grad_b += step_b**2
            w -= rate * step_w / (np.sqrt(grad_w) + 1e-8)
            b -= np.float32(rate * step_b / (grad_b**0.5 + 1e-8))
        self.weights, self.bias = w.astype(np.float64), float(b)

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[found].sum() + self.bias, -30, 30))))


def trained(docs: DataFrame, labels: DataFrame, train: Column, label: str = "toxic", sample: int = SAMPLE) -> Model:
    """train: condition on the column `labelled` (a doc_id) that says which labels may be learned."""
    rows = labelled(docs, labels, label, train, sample).dropDuplicates(["labelled"])
    rows = written(rows, "sample")
    known, strong = suspicious(rows)
    matcher = Matcher(known)

    @F.pandas_udf("binary")
    def match(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: matcher(t).tobytes())

    found = rows.select("labelled", "y", match("text").alias("f")).orderBy("labelled").toPandas()
    data = [(np.frombuffer(f, dtype=np.int32), int(y)) for y, f in zip(found.y, found.f, strict=True)]
    return Model(known, strong, data)


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    """Learned from the labels of the documents at hand; the fold with remainder 1 of 3 is held out."""
    return trained(docs, labels, remainder("labelled", 3) != 1)


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, score (0 to 1, higher is likelier toxic).

    Only the text is read. Null and empty texts match no term and score by the learned bias. A table without labels
    or without suspicious terms scores every text by the (smoothed) share of toxic labels. Repeated rows score
    equally; an empty table gives an empty table; other columns are ignored.
    """
    return docs.select(F.col(doc_id).alias("doc_id"), _score(docs, model)(whole(text)).alias("score"))


def kept(docs: DataFrame, model: Model, reject: float = 0.7) -> DataFrame:
    """The documents that score below `reject`, with all their columns."""
    return docs.where(_score(docs, model)(whole("text")) < reject)


def _score(docs: DataFrame, model: Model):
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(held.value.known)
        for batch in batches:
            yield pd.Series([held.value.score(matcher(t)) for t in batch], dtype="float64")

    return score
