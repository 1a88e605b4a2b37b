"""Chains of rows that point at each other, ranked without putting a chain in one task.

A round replaces every pointer by the pointer of the row it points at, so chains of any length are done in as many
rounds as their length has binary digits, and each round is one join on the pointers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tilewright.session import pin


def chain_ranks(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, id, rank, end``: the number of rows from each row to the end of its chain, itself included, and that end.

    ``links`` has ``keys, id, to``; ``to`` is null at the end of a chain. An ``id`` is unique within the keys and has one
    row that points at it at most. Rows of closed loops have no rank and are left out. A round in which no row comes to
    its end leaves only loops, since of an open chain some row would.
    """
    keys = list(keys)
    state = pin(links.select(*keys, "id", "to", F.lit(1).cast("bigint").alias("rank"), F.when(F.col("to").isNull(), F.col("id")).alias("end")))
    before = None
    while True:
        left = state.where("to is not null").count()
        if left in (0, before):
            return state.where("to is null").select(*keys, "id", "rank", "end")
        before = left
        ahead = state.select(*keys, F.col("id").alias("to"), F.col("to").alias("_to"), F.col("rank").alias("_rank"), F.col("end").alias("_end"))
        moving = state.where("to is not null").join(ahead, [*keys, "to"]).select(
            *keys, "id", F.col("_to").alias("to"), (F.col("rank") + F.col("_rank")).alias("rank"), F.col("_end").alias("end"))
        state = pin(state.where("to is null").unionByName(moving))


def reached(steps: DataFrame, starts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, id`` of all rows that are on the way of a start.

    ``steps`` has ``keys, id, to`` with ``to`` null where a way ends, ``starts`` has ``keys, id``. Ways may run together
    and never come back. Each round adds what lies one pointer ahead of what is reached, and doubles the pointers, so
    after n rounds everything up to 2**n steps ahead is there.
    """
    keys = list(keys)
    ahead = pin(steps.where("to is not null").select(*keys, "id", "to"))
    found = pin(starts.select(*keys, "id").distinct())
    while not ahead.isEmpty():
        more = found.join(ahead, [*keys, "id"]).select(*keys, F.col("to").alias("id"))
        found = pin(found.unionByName(more).distinct())
        further = ahead.select(*keys, F.col("id").alias("to"), F.col("to").alias("_to"))
        ahead = pin(ahead.join(further, [*keys, "to"]).select(*keys, "id", F.col("_to").alias("to")))
    return found
