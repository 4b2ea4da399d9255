"""Hash tables inside a row, for arrays that are matched against other arrays of the same row.

Spark looks a key up in a map by reading all its keys. Here entries lie sorted by the slot of their key's hash, and an
array says where each slot begins, so a look-up reads one slot whatever the number of entries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.text import let


def _slot(key: Column, slots: Column) -> Column:
    return F.pmod(F.xxhash64(key), slots)


def indexed(entries: Column) -> Column:
    """struct<slots, begins, entries> of array<struct<key:string, value:int>>; of equal keys the lowest value counts.

    Bind it (text.let) where it is looked up more than once.
    """

    def sort(given: Column) -> Column:
        slots = F.greatest(F.size(given), F.lit(1)).cast("long")
        row = lambda slot, real, key, value: F.struct(
            slot.alias("slot"), F.lit(real).alias("real"), key.cast("string").alias("key"), value.cast("int").alias("value")
        )
        null = F.lit(None)
        # One row without a key opens each slot, and one stands behind the last.
        marks = F.transform(F.sequence(F.lit(0).cast("long"), slots), lambda slot: row(slot, 0, null, null))
        keyed = F.transform(given, lambda e: row(_slot(e["key"], slots), 1, e["key"], e["value"]))
        return let(F.array_sort(F.concat(marks, keyed)), lambda rows: lowest(rows, slots))

    def lowest(rows: Column, slots: Column) -> Column:
        def is_new(x: Column, i: Column) -> Column:
            return (x["real"] == 0) | ~x["key"].eqNullSafe(F.get(rows, i - 1)["key"])

        return let(F.filter(rows, is_new), lambda kept: table(kept, slots))

    def table(kept: Column, slots: Column) -> Column:
        at = F.transform(kept, lambda x, i: F.when(x["real"] == 0, i - x["slot"].cast("int")))
        return F.struct(
            slots.alias("slots"),
            F.array_compact(at).alias("begins"),
            F.transform(F.filter(kept, lambda x: x["real"] == 1), lambda x: F.struct(x["key"], x["value"])).alias("entries"),
        )

    return let(entries, sort)


def found(index: Column, key: Column) -> Column:
    """The value of a key, NULL if it is not there."""

    def in_slot(slot: Column) -> Column:
        begin, end = F.get(index["begins"], slot), F.get(index["begins"], slot + 1)
        same = F.filter(F.slice(index["entries"], begin + 1, end - begin), lambda e: e["key"] == key)
        return F.get(same, F.lit(0))["value"]

    return let(_slot(key, index["slots"]).cast("int"), in_slot)


def substrings(text: Column, lengths: Column) -> Column:
    """Distinct substrings of a text that have one of the lengths."""
    fitting = F.filter(lengths, lambda n: n <= F.length(text))
    starts = lambda n: F.sequence(F.lit(1), F.length(text) - n + 1)
    return F.array_distinct(
        F.flatten(F.transform(fitting, lambda n: F.transform(starts(n), lambda at: F.substr(text, at, n))))
    )
