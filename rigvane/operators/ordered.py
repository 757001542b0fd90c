"""Running values of long histories without a task that holds a whole history.

Windows are cut into buckets of the order's first column; what a bucket needs from those before it is
carried by one row for each bucket.  Algorithms that are sequential by nature get a key's rows in order, batch
after batch, and keep only their state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def bucket_of(column: str, width: float) -> Column:
    return F.floor(F.col(column) / F.lit(width))


def with_carry(rows: DataFrame, keys: list[str], order: list[str], width: float, last: Column, out: str) -> DataFrame:
    """Adds `__b`, the bucket of each row by order[0], and `out`: `last` (an aggregate; null where a bucket has
    nothing to say) of the nearest bucket before it that has one."""
    cut = rows.withColumn("__b", bucket_of(order[0], width))
    ends = cut.groupBy(*keys, "__b").agg(last.alias("__last"))
    before = F.last("__last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    same = lambda k: F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    ends = ends.select(*[F.col(k).alias(f"__k_{k}") for k in [*keys, "__b"]], before.alias(out))
    on = same("__b")
    for k in keys:
        on = on & same(k)
    return cut.join(ends, on, "left").drop(*[f"__k_{k}" for k in [*keys, "__b"]])


def previous(rows: DataFrame, keys: list[str], order: list[str], value: str, width: float, out: str) -> DataFrame:
    """Adds the value of the row before, in each key's order."""
    last = F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order))
    part = with_carry(rows, keys, order, width, last, "__carry")
    w = Window.partitionBy(*keys, "__b").orderBy(*order)
    before = F.when(F.row_number().over(w) == 1, F.col("__carry.v")).otherwise(F.lag(value).over(w))
    return part.withColumn(out, before).drop("__carry", "__b")


def numbered(rows: DataFrame, keys: list[str], order: list[str], width: float, out: str) -> DataFrame:
    """Adds 1, 2, ... in each key's order."""
    return running_sum(rows.withColumn("__one", F.lit(1)), keys, order, "__one", width, out).drop("__one")


def running_sum(rows: DataFrame, keys: list[str], order: list[str], value: str, width: float, out: str) -> DataFrame:
    """Adds the sum of the values up to the row, itself included, in each key's order."""
    cut = rows.withColumn("__b", bucket_of(order[0], width))
    sums = cut.groupBy(*keys, "__b").agg(F.sum(value).alias("__s"))
    before = F.sum("__s").over(Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*keys, "__b", before.alias("__before"))
    w = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = F.sum(value).over(w)
    total = F.when(F.col("__before").isNull(), own).otherwise(F.col("__before") + F.coalesce(own, F.lit(0)))
    return cut.join(sums, [*keys, "__b"]).withColumn(out, total).drop("__b", "__before")


def _new_keys(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Which rows have another key than the row before; the first one has."""
    new = np.ones(len(pdf), dtype=bool)
    new[1:] = np.any([(v := pdf[k].to_numpy())[1:] != v[:-1] for k in keys], axis=0)  # as they are: shift() would turn integers into floats
    return new


def in_order(rows: DataFrame, keys: list[str], order: list[str], start: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: T.StructType | str) -> DataFrame:
    """For each key a function from start() gets the key's rows in order, piece by piece, and gives rows of the schema.

    Keys are dealt to tasks and sorted there by Spark, which spills; a task holds one piece and one state, however long
    a key's history is.  Rows of one key are worked on one after another, as such algorithms need it; rows with a null
    key are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, step = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            starts = [*_new_keys(pdf, keys).nonzero()[0].tolist(), len(pdf)]
            for a, b in zip(starts, starts[1:]):
                key = tuple(pdf[k].iloc[a] for k in keys)
                if step is None or key != own:
                    own, step = key, start()
                # An empty frame has lost its columns' types, which Arrow does not take for strings.
                if len(out := step(pdf.iloc[a:b])):
                    yield out

    return rows.where(" and ".join(f"`{k}` is not null" for k in keys)).repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


#: Numbers that a piece of rows has at most in `_through`, one for each row and state; rows that small batches are gathered to.
PIECE, GATHER = 2**20, 10_000


def _gathered(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """The same rows in batches of `rows` or more: sessions may send few at a time."""
    held, n = [], 0
    for pdf in batches:
        if not len(pdf):
            continue
        held.append(pdf)
        n += len(pdf)
        if n >= rows:
            yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
            held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def _through(batches: Iterator[pd.DataFrame], keys: list[str], n_states: int, moves: Callable[[pd.DataFrame], np.ndarray]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of sorted rows with: whether a row is its key's first one, and the state before and after it for each state that the key may begin in.

    The rows' functions are put together by doubled distances, those of all keys of a piece at once; a key that goes on in the next piece leaves one function."""
    own, last, same = None, None, np.arange(n_states)
    size = max(1, PIECE // n_states)
    for pdf in _gathered(batches, min(size, GATHER)):
        for a in range(0, len(pdf), size):
            p = pdf.iloc[a : a + size]
            new, i = _new_keys(p, keys), np.arange(len(p))
            place = i - np.maximum.accumulate(np.where(new, i, 0))
            after, far = np.array(moves(p)), 1
            while len(at := np.flatnonzero(place >= far)):
                after[at] = np.take_along_axis(after[at], after[at - far], axis=1)
                far *= 2
            before = np.vstack([same, after[:-1]])
            before[new] = same
            if own is not None and own == tuple(p[k].iloc[0] for k in keys):
                on = place == i
                after[on], before[on], new[0] = after[on][:, last], before[on][:, last], False
            own, last = tuple(p[k].iloc[-1] for k in keys), after[-1]
            yield p, new, before, after


def states_before(rows: DataFrame, keys: list[str], order: list[str], width: float, n_states: int, moves: Callable[[pd.DataFrame], np.ndarray], out: str, start: int = 0) -> DataFrame:
    """Rows with the state that each of them meets, of an automaton with states 0 .. n_states - 1 that goes through each key's rows in order.

    moves(rows) gives an array with a line for each row: the next state of each of the states.  A history is cut into buckets of order[0]; what a bucket does to every
    state it may begin in is found for all buckets side by side, the buckets' functions (one short row for each) are put together in order, and then every bucket is
    gone through once more from the state it begins in.  So many tasks work on one key's history, and short histories go through Python many at a time.
    rows has only columns that pandas can hold; rows with a null key are left out."""
    names, parts = rows.columns, [*keys, "__b"]
    cut = rows.withColumn("__b", bucket_of(order[0], width)).where(" and ".join(f"`{k}` is not null" for k in parts))
    dealt = cut.repartition(*parts)  # both readers below have this one exchange

    def functions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for p, new, _, after in _through(batches, parts, n_states, moves):
            if held is not None and new[0]:
                yield held
            ends = np.flatnonzero(np.append(new[1:], True))
            done = p[parts].iloc[ends].assign(__to=list(after[ends]))
            held = done.iloc[-1:]
            if len(ends) > 1:
                yield done.iloc[:-1]
        if held is not None:
            yield held

    def begins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p, new, before, _ in _through(batches, keys, n_states, lambda p: np.stack(p["__to"].to_numpy())):
            # A key's first bucket begins in `start`.
            if len(later := p[parts].assign(__at=before[:, start])[~new]):
                yield later

    def states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p, _, before, _ in _through(batches, parts, n_states, moves):
            yield p[names].assign(**{out: before[np.arange(len(p)), p["__at"].to_numpy()]})

    key_fields = [cut.schema[k] for k in parts]
    maps = dealt.sortWithinPartitions(*parts, *order).mapInPandas(functions, T.StructType([*key_fields, T.StructField("__to", T.ArrayType(T.LongType()))]))
    later = maps.repartition(*keys).sortWithinPartitions(*parts).mapInPandas(begins, T.StructType([*key_fields, T.StructField("__at", T.LongType())]))
    begun = dealt.join(later, parts, "left").withColumn("__at", F.coalesce("__at", F.lit(start)))
    return begun.sortWithinPartitions(*parts, *order).mapInPandas(states, T.StructType([*rows.schema, T.StructField(out, T.LongType())]))
