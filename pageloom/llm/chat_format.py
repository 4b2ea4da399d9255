"""Conversations as training text with a loss mask, by Spark expressions only.

Each block of the output is `<s>`, an opening mark, text, a closing mark. Neighbouring turns of one role share a
block; a seam mark stands between them, so that reading the output back gives every turn. A control string inside a
text gets one backslash after its first character (one more if it has some), which `turns_of` takes away again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import let
from pageloom.llm.common import whole

START, SEAM = "<s>", "[+]"
USER, ASSISTANT, OTHER = ("[INST] ", " [/INST]"), ("[ANS] ", "</s>"), ("[ROLE ", " [/ROLE]")
#: Control strings, each cut after its first character; backslashes may stand between the two parts.
_TAIL = r"(/?s>|/?INST\]|/?ANS\]|/?ROLE\b|\+\])"
_ESCAPE, _UNESCAPE = rf"([<\[])(\\*){_TAIL}", rf"([<\[])\\(\\*){_TAIL}"

#: Letters of a portion of a formatted conversation, where it is cut.
PORTION = 1_000


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


def _open(role: Column) -> Column:
    other = F.concat(F.lit(OTHER[0]), F.url_encode(role), F.lit("] "))
    marks = F.when(role == "user", USER[0]).when(role == "assistant", ASSISTANT[0]).otherwise(other)
    return F.concat(F.lit(START), marks)


def _close(role: Column) -> Column:
    return F.when(role == "user", USER[1]).when(role == "assistant", ASSISTANT[1]).otherwise(F.lit(OTHER[1]))


def formatted(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"):
    """One row per conversation: conv_id, formatted, loss_spans (array of start, length in characters, from 0).

    Turns are ordered by turn (null first), then role and text, so ties and repeated rows have one order and all stay.
    Null roles and texts read as empty; a row without a conv_id is a conversation of its own, for nothing says which of
    them belong together. The loss mask covers the escaped text of each assistant turn. An empty table gives an empty
    table; other columns are ignored. Work grows with the turns of a conversation (their number times its logarithm).
    """
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.when(F.col(conv_id).isNull(), F.monotonically_increasing_id()).alias("lone"),
        F.struct(F.col(turn).alias("turn"), whole(role).alias("role"), whole(text).alias("text")).alias("t"),
    )
    chats = rows.groupBy("conv_id", "lone").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # Where a block begins: the first turn, and each whose role differs from the turn before.
    starts = F.filter(
        F.sequence(F.lit(0), F.size("turns") - 1),
        lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", F.greatest(i - 1, F.lit(0)))["role"]),
    )
    chats = chats.withColumn("starts", starts)
    blocks = F.transform(
        "starts",
        lambda s, k: F.struct(
            F.get("turns", s)["role"].alias("role"),
            F.transform(
                F.slice("turns", s + 1, F.coalesce(F.get("starts", k + 1), F.size("turns")) - s),
                lambda t: escaped(t["text"]),
            ).alias("parts"),
        ),
    )
    chats = chats.select("conv_id", blocks.alias("blocks"))
    pieces = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.concat(
                F.array(_piece(_open(b["role"]), F.lit(False))),
                F.flatten(
                    F.transform(
                        b["parts"],
                        lambda p, i: F.when(i == 0, F.array(_piece(p, b["role"] == "assistant"))).otherwise(
                            F.array(_piece(F.lit(SEAM), F.lit(False)), _piece(p, b["role"] == "assistant"))
                        ),
                    )
                ),
                F.array(_piece(_close(b["role"]), F.lit(False))),
            ),
        )
    )
    chats = chats.select("conv_id", pieces.alias("pieces"))
    lengths = F.transform("pieces", lambda p: F.length(p["text"]))
    spans = let(
        let(lengths, _running_sums),
        lambda ends: F.array_compact(
            F.transform("pieces", lambda p, i: F.when(p["loss"], _span(F.get(ends, i), F.length(p["text"]))))
        ),
    )
    return chats.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"),
        spans.alias("loss_spans"),
    )


def _span(end: Column, length: Column) -> Column:
    return F.struct((end - length).alias("start"), length.alias("length"))


def _running_sums(values: Column) -> Column:
    """Sums up to each place: in each round a place adds what stands 1, 2, 4, ... places before it."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))
    step = lambda k: F.pow(F.lit(2), k).cast("int")
    return F.aggregate(
        rounds,
        values,
        lambda sums, k: F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - step(k)), F.lit(0))),
    )


def _piece(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def turns_of(text: Column) -> Column:
    """The turns read back from a formatted conversation: array of role, text."""
    blocks = F.slice(F.split(text, START, -1), 2, 2**30)

    def parsed(b: Column) -> Column:
        other = F.url_decode(F.regexp_extract(b, r"^\[ROLE ([^\]]*)\] ", 1))
        role = F.when(b.startswith(USER[0]), "user").when(b.startswith(ASSISTANT[0]), "assistant").otherwise(other)
        before = (
            F.when(b.startswith(USER[0]), len(USER[0]))
            .when(b.startswith(ASSISTANT[0]), len(ASSISTANT[0]))
            .otherwise(F.length(F.regexp_extract(b, r"^\[ROLE [^\]]*\] ", 0)))
        )
        body = F.substring(b, before + 1, F.length(b) - before - F.length(_close(role)))
        return F.transform(
            F.split(body, r"\[\+\]", -1), lambda p: F.struct(role.alias("role"), unescaped(p).alias("text"))
        )

    return F.flatten(F.transform(blocks, parsed))


def loss_text(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order.

    Spans are cut from portions of the text: a place in a string is found by walking to it from the string's start.
    """

    def cut(portions: Column) -> Column:
        def of(s: Column) -> Column:
            first, last = (F.floor(x / PORTION).cast("int") for x in (s["start"], s["start"] + s["length"]))
            near = F.array_join(F.slice(portions, first + 1, last - first + 1), "")
            return unescaped(F.substring(near, s["start"] - first * PORTION + 1, s["length"]))

        return F.array_join(F.transform(spans, of), "")

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PORTION}}}"), F.lit(0)), cut)


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of the output of `formatted`."""
    parsed = chats.select(
        "conv_id",
        turns_of(F.col("formatted")).alias("turns"),
        loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    whole_turns = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole_turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
