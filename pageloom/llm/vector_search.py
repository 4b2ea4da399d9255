"""Nearest vectors by inner product: one-bit codes of randomly rotated vectors choose what is compared exactly.

A vector o is coded against the nearest c of some centres. o - c, turned by a random rotation into BITS dimensions, keeps
only its signs s, one bit each. With r = |o - c| and f the cosine of the turned vector and s, the product with a query q is
estimated without o:

    <o, q> ~ <c, q> + <o - c, c> + r / (f sqrt(BITS)) <s, P(q - c)>

The rotation makes the error of the last term behave like r |q - c| sqrt(1 - f^2) / f / sqrt(BITS - 1) times a standard
normal number. All but <c, q> and <s, Pq> depends on o alone and is kept in three numbers beside the bits.

Codes are read twice, in blocks: blocks of codes meet blocks of the stated queries, so the work is queries x rows, but on
bits. The first reading finds each query's best estimates, whose exact products give a bound that its last neighbour
reaches. The second keeps every row whose estimate plus SURE errors reaches that bound; those are compared exactly.
Whole vectors travel only for pairs that were chosen.

Equal vectors are one vector with the smallest ids of its rows, so a vector that fills a third of a table is coded and
compared once; centres near many almost equal vectors keep r, and with it the number of chosen pairs, small.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pageloom.llm.common import written

#: Bits of a code at least; more than a vector's numbers, they are multiples of 64.
BITS = 512
#: Best estimates of a query that are compared exactly for its bound, as a multiple of the neighbours wanted.
SEEDS = 4
#: Errors that a pair may lie above its estimate without being missed.
SURE = 2.4
#: Centres, and the rows of smallest hashes that they are fitted to. Every row is coded.
CENTRES, SAMPLE, ROUNDS = 64, 4_096, 8
#: Codes and queries in a block, and queries compared with a block of codes at once.
CODES_AT_ONCE, QUERIES_AT_ONCE, SLICE = 8_192, 2_048, 64
CODE_KIND = "ids binary, centres binary, bits binary, numbers binary"
QUERY_KIND = "queries binary, vectors binary, reach binary"
PAIR_KIND = "query long, rep long, estimate double"


@dataclass(frozen=True)
class Coder:
    """Centres and a rotation; everything else follows from a vector alone."""

    centres: np.ndarray
    turn: np.ndarray

    @property
    def bits(self) -> int:
        return self.turn.shape[1]

    def coded(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Centre numbers, packed signs, and per vector (factor of <s, Pq>, addend, error per |q - c|)."""
        near = np.empty(len(vectors), np.int32)
        half = (self.centres**2).sum(1) / 2
        for k in range(0, len(vectors), 1_024):
            near[k : k + 1_024] = (vectors[k : k + 1_024] @ self.centres.T - half).argmax(1)
        centre = self.centres[near]
        left = vectors - centre
        r = np.linalg.norm(left, axis=1)
        turned = left @ self.turn
        positive = turned > 0
        root = np.sqrt(self.bits)
        with np.errstate(divide="ignore", invalid="ignore"):
            f = np.where(r > 0, np.abs(turned).sum(1) / (root * r), 1.0)
            factor = np.where(r > 0, r / (f * root), 0.0)
            error = r * np.sqrt(np.maximum(0.0, 1 - f * f)) / f / np.sqrt(self.bits - 1)
        signs = np.where(positive, 1.0, -1.0)
        of_centre = np.einsum("ij,ij->i", signs, (self.centres @ self.turn)[near])
        addend = np.einsum("ij,ij->i", left, centre) - factor * of_centre
        return near, np.packbits(positive, axis=1), np.stack([factor, addend, error], 1)


def coder(sample: np.ndarray, bits: int = BITS, seed: int = 12) -> Coder:
    """Centres by some rounds of k-means over a bounded sample; a rotation of the zero-padded space."""
    random = np.random.default_rng(seed)
    width = sample.shape[1]
    bits = -(-max(bits, width) // 64) * 64
    turn = np.linalg.qr(random.standard_normal((bits, width)))[0].T
    centres = sample[np.sort(random.choice(len(sample), min(CENTRES, len(sample)), replace=False))]
    for _ in range(ROUNDS):
        near = (sample @ centres.T - (centres**2).sum(1) / 2).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        counts = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(counts > 0, sums / np.maximum(counts, 1), centres)
    return Coder(centres, turn)


def _blocks(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Rows of a task in blocks of `size`."""
    held: list[pd.DataFrame] = []
    count = 0
    for batch in batches:
        while len(batch):
            part, batch = batch.iloc[: size - count], batch.iloc[size - count :]
            held.append(part)
            count += len(part)
            if count == size:
                yield pd.concat(held)
                held, count = [], 0
    if held:
        yield pd.concat(held)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _codes(vectors: DataFrame, code: Coder) -> DataFrame:
    """Blocks of codes of vectors(rep, vector)."""

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _blocks(batches, CODES_AT_ONCE):
            near, bits, numbers = code.coded(_matrix(block["vector"]))
            ids = block["rep"].to_numpy(np.int64).tobytes()
            row = (ids, near.tobytes(), bits.tobytes(), numbers.tobytes())
            yield pd.DataFrame([row], columns=["ids", "centres", "bits", "numbers"])

    return vectors.select("rep", "vector").mapInPandas(packed, CODE_KIND)


def _query_blocks(queries: DataFrame) -> DataFrame:
    """Blocks of queries(rep, vector, reach); reach may be negative infinity."""

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _blocks(batches, QUERIES_AT_ONCE):
            ids, reach = block["rep"].to_numpy(np.int64), block["reach"].to_numpy(np.float64)
            row = (ids.tobytes(), _matrix(block["vector"]).tobytes(), reach.tobytes())
            yield pd.DataFrame([row], columns=["queries", "vectors", "reach"])

    return queries.select("rep", "vector", "reach").mapInPandas(packed, QUERY_KIND)


def _estimated(codes: DataFrame, blocks: DataFrame, code: Coder, best: int | None) -> DataFrame:
    """Pairs (query, rep, estimate): each query's `best` estimates in every block of codes, or all that may reach its bound."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        width = code.centres.shape[1]
        for batch in batches:
            for pair in batch.itertuples(index=False):
                ids, near = np.frombuffer(pair.ids, np.int64), np.frombuffer(pair.centres, np.int32)
                packed = np.frombuffer(pair.bits, np.uint8).reshape(len(ids), -1)
                signs = np.unpackbits(packed, axis=1).astype(np.float32) * 2 - 1
                factor, addend, error = np.frombuffer(pair.numbers, np.float64).reshape(-1, 3).T
                queries, reach = np.frombuffer(pair.queries, np.int64), np.frombuffer(pair.reach, np.float64)
                vectors = np.frombuffer(pair.vectors, np.float64).reshape(-1, width)
                for k in range(0, len(queries), SLICE):
                    q = vectors[k : k + SLICE]
                    to_centre = q @ code.centres.T
                    products = ((q @ code.turn).astype(np.float32) @ signs.T).astype(np.float64)
                    estimate = to_centre[:, near] + addend + factor * products
                    if best is None:
                        away = np.sqrt(np.maximum(0.0, (q**2).sum(1)[:, None] - 2 * to_centre + (code.centres**2).sum(1)))
                        # What single precision loses in the product of the bits.
                        lost = 1e-5 * np.linalg.norm(q, axis=1)[:, None] * factor * np.sqrt(code.bits)
                        at = np.nonzero(estimate + SURE * error * away[:, near] + lost >= reach[k : k + SLICE, None])
                    else:
                        most = min(best, len(ids))
                        columns = np.argpartition(estimate, len(ids) - most, axis=1)[:, len(ids) - most :]
                        at = (np.repeat(np.arange(len(q)), most), columns.ravel())
                    if len(at[0]):
                        yield pd.DataFrame({"query": queries[k + at[0]], "rep": ids[at[1]], "estimate": estimate[at]})

    # A stated set of queries against all rows, block by block: a row of this product is a pair of blocks.
    return codes.crossJoin(blocks).mapInPandas(read, PAIR_KIND)


def inner(a: Column | str, b: Column | str) -> Column:
    """Inner product of two arrays of doubles, summed from the first number on."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def _exact(pairs: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Pairs (query, rep) with their exact product."""
    of_row = vectors.select("rep", F.col("vector").alias("row_vector"))
    of_query = queries.select(F.col("rep").alias("query"), F.col("vector").alias("query_vector"))
    met = pairs.select("query", "rep").join(of_row, "rep").join(of_query, "query")
    return met.select("query", "rep", inner("row_vector", "query_vector").alias("score"))


def usable(vector: Column) -> Column:
    """A vector of finite numbers that are not all zero, as doubles; null for any other."""
    doubles = vector.cast("array<double>")
    finite = ~F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(finite & F.exists(doubles, lambda x: x != 0), doubles)


def nearest(
    rows: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", bits: int = BITS
) -> DataFrame:
    """The k rows of largest inner product with each query row: query_id, rank (from 1), vec_id, score.

    is_query is a condition on vec_id, which is a long. A query is not its own neighbour; ties go to the smaller vec_id.
    Scores are exact; a neighbour may be missed where its estimate errs by more than SURE errors.

    Null and zero vectors, vectors with nulls or numbers that are not finite, and rows without an id take no part, as do
    vectors of another length than the most common one (of equally common ones the longer). Of several rows with one id
    the one with the smallest vector counts. With fewer other rows than k all are given; an empty table gives none.
    """
    given = rows.select(F.col(vec_id).cast("long").alias("vec_id"), usable(F.col(vector)).alias("vector"))
    given = given.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    width = given.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if width is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fitting = given.where(F.size("vector") == width["width"])
    single = written(fitting.groupBy("vec_id").agg(F.min("vector").alias("vector")), "vectors")

    # Of the rows of one vector the k + 1 smallest ids are enough: one may be the query's own.
    nth = F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))
    few = single.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    grouped = few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    vectors = written(grouped.select(F.get("ids", F.lit(0)).alias("rep"), "ids", "vector"), "distinct")
    asked = written(single.where(is_query).join(vectors.select("rep", "vector"), "vector").select("vec_id", "rep"), "asked")
    queries = written(vectors.select("rep", "vector").join(asked.select("rep").distinct(), "rep"), "queries")

    chosen = vectors.select("rep", "vector").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).orderBy("rep")
    code = coder(_matrix(chosen.toPandas()["vector"]), bits)
    codes = written(_codes(vectors, code), "codes")

    free = queries.withColumn("reach", F.lit(float("-inf")))
    blocks = written(_query_blocks(free), "query_blocks")
    order = W.partitionBy("query").orderBy(F.desc("estimate"), "rep")
    many = SEEDS * (k + 1)
    best = _estimated(codes, blocks, code, many).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= many)
    seeds = written(_exact(best, vectors, queries), "seeds")
    # A query reaches its (k + 1)st best seed. With fewer seeds there are no other rows, and any bound will do.
    of_score = W.partitionBy("query").orderBy(F.desc("score"), "rep")
    first = seeds.withColumn("nth", F.row_number().over(of_score)).where(F.col("nth") <= k + 1)
    reach = first.groupBy("query").agg(F.min("score").alias("reach"))
    bound = written(_query_blocks(queries.join(reach, F.col("rep") == F.col("query")).drop("query")), "bound_blocks")
    pairs = _estimated(codes, bound, code, None)
    known = seeds.select("query", "rep")
    found = _exact(pairs.select("query", "rep").join(known, ["query", "rep"], "left_anti"), vectors, queries).unionByName(seeds)

    # A query's neighbours, k + 1 with its own row among them, as one array: equal queries share it.
    placed = found.join(vectors.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("vec_id"))
    order = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = placed.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
    listed = top.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("near"))
    own = asked.withColumnRenamed("vec_id", "query_id").join(listed, F.col("rep") == F.col("query"))
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(others).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score"
    )
