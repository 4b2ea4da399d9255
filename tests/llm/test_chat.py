from __future__ import annotations

import hashlib
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pageloom.llm import chat_format

PIECES = ["<s>", "</s>", "[INST]", " [/INST]", "[+]", "[ROLE ", "[/ROLE]", "[ANS] ", "\\", "<", "[", " ", "a", "é", "\n", "\\s>", "+]"]


def back(spark, turns):
    schema = "conv_id bigint, turn int, role string, text string, blocks string, pieces string"
    df = spark.createDataFrame([(*t, "x", "y") for t in turns], schema)
    out = chat_format.formatted(df)
    parsed = out.select("conv_id", chat_format.turns_of(out.formatted).alias("t"), "formatted")
    return {r.conv_id: ([(x.role, x.text) for x in r.t], r.formatted) for r in parsed.collect()}, chat_format.read_back(out)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=8).map("".join), min_size=1, max_size=6))
def test_round_trip(spark, texts):
    roles = ["user", "assistant", "assistant", "system", "user", "to ol]"]
    turns = [(1, i, roles[i], t) for i, t in enumerate(texts)]
    got, digest = back(spark, turns)
    assert got[1][0] == [(r, t) for *_, r, t in turns]
    row = digest.first()
    loss = "".join(t for *_, r, t in turns if r == "assistant")
    assert row.loss_chars == len(loss) and row.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert row.n_turns == len(turns) and row.formatted_chars == len(got[1][1])


def test_neighbours_share_a_block(spark):
    got, _ = back(spark, [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")])
    assert got[1][1] == "<s>[INST] a[+]b [/INST]<s>[ANS] c</s>"


def test_nulls_ties_and_repeated_rows(spark):
    turns = [(None, 0, None, None), (2, 1, "user", "b"), (2, 1, "user", "a"), (2, 1, "user", "a"), (2, None, "assistant", "z")]
    got, _ = back(spark, turns)
    assert got[None][0] == [("", "")]
    assert got[2][0] == [("assistant", "z"), ("user", "a"), ("user", "a"), ("user", "b")]


def test_rows_without_a_conversation_stand_alone(spark):
    df = spark.createDataFrame([(None, 0, "user", "a")] * 3 + [(7, 0, "user", "a")], "conv_id bigint, turn int, role string, text string")
    digest = chat_format.read_back(chat_format.formatted(df)).collect()
    assert sorted((r.conv_id is None, r.n_turns) for r in digest) == [(False, 1)] + [(True, 1)] * 3


def test_many_turns_in_one_conversation(spark):
    """100,000 turns; the loss mask is still exact."""
    start = time.monotonic()
    role = F.when(F.col("id") % 3 == 0, "user").otherwise("assistant")
    df = spark.range(100_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.col("id").cast("string").alias("text"))
    row = chat_format.read_back(chat_format.formatted(df)).first()
    loss = "".join(str(i) for i in range(100_000) if i % 3)
    assert row.n_turns == 100_000 and row.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert time.monotonic() - start < 40


def test_long_text(spark):
    long = "<s>x" * 50_000
    assert back(spark, [(1, 0, "assistant", long)])[0][1][0] == [("assistant", long)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn int, role string, text string")
    assert chat_format.read_back(chat_format.formatted(df)).count() == 0
    with pytest.raises(Exception, match="role"):
        chat_format.formatted(df.drop("role")).count()
