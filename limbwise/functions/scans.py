"""Ordered scans that stay parallel when one key holds most of the rows.

A plain window ``PARTITION BY key ORDER BY t`` puts a hot key into one task. Every
helper here partitions by ``(key, slice)`` instead, where ``slice`` is a monotone
function of the order (an hour, an id range, a hash prefix). Each slice is summarised
to one row, the summaries are scanned per key, and the carry is joined back on
``(key, slice)`` - the partitioning the rows already have. Results are exact. Keys and
slice are held in one struct, in which null equals null, so rows without a key or a time
are a group like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limbwise.functions.columns import keyed_join
from limbwise.sources.workspace import cut

_FOLD = {"sum": F.sum, "max": F.max, "min": F.min}
#: Slices of a piece whose transfer tables are followed in one group; longer pieces are walked by pointer doubling
FOLLOWED = 256


class Scan(NamedTuple):
    """One running aggregate: ``sum``, ``max`` or ``min`` of ``value`` along the order."""

    kind: str
    value: Column
    backward: bool = False
    inclusive: bool = True


def _merge(kind: str, a: Column, b: Column) -> Column:
    if kind == "sum":
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return (F.greatest if kind == "max" else F.least)(a, b)


def running(df: DataFrame, keys: Sequence[str], slice_col: str, order: Sequence[Column],
            outputs: dict[str, Scan]) -> DataFrame:
    """Running aggregates over each key in order, all ``outputs`` in one pass.

    ``order`` must be total within a slice and ``slice_col`` monotone in it. Backward
    scans run from the end; exclusive ones leave the row itself out.
    """
    keys = list(keys)

    def ordered(part: list[str], cols: Sequence[Column], scan: Scan, own: bool):
        cols = [c.desc() if scan.backward else c.asc() for c in cols]
        return Window.partitionBy(*part).orderBy(*cols).rowsBetween(Window.unboundedPreceding, 0 if own else -1)

    held = df.withColumn("_g", F.struct(*keys, slice_col))
    per_slice = held.groupBy("_g").agg(
        *[_FOLD[s.kind](s.value).alias(f"_t_{name}") for name, s in outputs.items()])
    carry = per_slice.select("_g", *[
        _FOLD[s.kind](f"_t_{name}").over(ordered([f"_g.{k}" for k in keys], [F.col(f"_g.{slice_col}")], s, False)).alias(f"_c_{name}")
        for name, s in outputs.items()])
    local = held.select("*", *[
        _FOLD[s.kind](s.value).over(ordered(["_g"], order, s, s.inclusive)).alias(f"_w_{name}")
        for name, s in outputs.items()])
    joined = local.join(carry, "_g", "left")
    kept = [F.col(c) for c in df.columns if c not in outputs]
    return joined.select(*kept, *[
        _merge(s.kind, F.col(f"_c_{name}"), F.col(f"_w_{name}")).alias(name) for name, s in outputs.items()])


def trailing(df: DataFrame, keys: Sequence[str], slice_col: str, order: Sequence[Column],
             value: Column, size: int, out: str, carry_out: str | None = None,
             position_out: str | None = None) -> DataFrame:
    """Array of the last ``size`` values up to and including each row, oldest first.

    Slice tails hold at most ``size`` values, and a slice's carry reads only the tails
    that reach into the last ``size`` rows, so no array outgrows ``2 * size``.
    ``carry_out`` keeps the values that precede the slice, ``position_out`` the 1-based
    row number within the key.
    """
    keys = list(keys)
    by_key = Window.partitionBy(*[f"_g.{k}" for k in keys])
    inner = Window.partitionBy("_g").orderBy(*order)
    local = df.withColumn("_g", F.struct(*keys, slice_col)).select("*", F.collect_list(value).over(inner.rowsBetween(-(size - 1), 0)).alias("_own"),
                      F.row_number().over(inner).alias("_pos"))
    tails = local.groupBy("_g").agg(
        F.max_by("_own", "_pos").alias("_tail"), F.max("_pos").cast("bigint").alias("_n"))
    reach = by_key.orderBy("_end").rangeBetween(-(size - 1), 0)
    carry = (tails
             .withColumn("_end", F.sum("_n").over(
                 by_key.orderBy(f"_g.{slice_col}").rowsBetween(Window.unboundedPreceding, 0)))
             .withColumn("_upto", F.flatten(F.collect_list("_tail").over(reach)))
             .withColumn("_carry", F.lag(_last(F.col("_upto"), size)).over(by_key.orderBy(f"_g.{slice_col}")))
             .select("_g", "_carry", (F.col("_end") - F.col("_n")).alias("_before")))
    joined = local.join(carry, "_g", "left")
    carried = F.coalesce("_carry", F.slice("_own", 1, 0))
    cols = [F.col(c) for c in df.columns]
    cols.append(_last(F.concat(carried, F.col("_own")), size).alias(out))
    if carry_out:
        cols.append(carried.alias(carry_out))
    if position_out:
        cols.append((F.col("_before") + F.col("_pos")).alias(position_out))
    return joined.select(*cols)


def sliding(df: DataFrame, keys: Sequence[str], slice_col: str, order: Sequence[str], value: str, size: int,
            fold: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], outputs: str) -> DataFrame:
    """Figures of the last ``size`` values of each row, where a window function would build an array per row.

    A slice is taken as one group: ``fold(carried, values)`` gets the up to ``size - 1`` values before the slice and those of the
    slice in order, and gives an array per column of ``outputs`` (a DDL list). Only the carried tails, one a slice, are arrays in Spark.
    """
    keys = list(keys)
    inner = Window.partitionBy("_g")
    held = df.withColumn("_g", F.struct(*keys, slice_col))
    ranked = held.select("_g", F.col(value).alias("_v"), F.row_number().over(inner.orderBy(*[F.desc(c) for c in order])).alias("_back"))
    tails = ranked.groupBy("_g").agg(F.count("*").alias("_n"), F.transform(F.array_sort(F.collect_list(
        F.when(F.col("_back") < size, F.struct((-F.col("_back")).alias("at"), F.col("_v").alias("v"))))), lambda x: x["v"]).alias("_tail"))
    by_key = Window.partitionBy(*[f"_g.{k}" for k in keys]).orderBy(f"_g.{slice_col}")
    reach = Window.partitionBy(*[f"_g.{k}" for k in keys]).orderBy("_end").rangeBetween(-(size - 2), 0) if size > 1 else by_key.rowsBetween(0, 0)
    carried = (tails.withColumn("_end", F.sum("_n").over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
               .withColumn("_upto", F.flatten(F.collect_list("_tail").over(reach)))
               .select("_g", F.lag(_last(F.col("_upto"), size - 1)).over(by_key).alias("_carry")))
    made = T.StructType.fromDDL(outputs).names
    schema = T.StructType([*held.drop("_g").schema, *T.StructType.fromDDL(outputs)])

    def run(key, rows: pa.Table, carry: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in order], null_placement="at_start"))
        before = carry["_carry"][0].as_py() if len(carry) else None
        found = fold(np.array([np.nan if v is None else v for v in before or []], np.float64), rows[value].to_numpy().astype(np.float64))
        for name in made:
            rows = rows.append_column(name, pa.array(found[name], from_pandas=True))
        return rows.select(schema.names)
    return held.groupBy("_g").cogroup(carried.groupBy("_g")).applyInArrow(run, schema)


def _last(arr: Column, size: int) -> Column:
    n = F.size(arr)
    return F.slice(arr, F.greatest(n - size, F.lit(0)) + 1, F.lit(size))


def hash_slice(hashed: Column, hex_digits: int = 3) -> Column:
    """Slice for md5-ordered scans: even by construction, 16**hex_digits per key."""
    return F.substring(hashed, 1, hex_digits)


def time_slice(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)).cast("bigint")


def positions(df: DataFrame, keys: Sequence[str], slice_col: str, order: Sequence[Column], out: str) -> DataFrame:
    """1-based row number of each key in order."""
    return running(df, keys, slice_col, order, {out: Scan("sum", F.lit(1).cast("bigint"))})


def greedy_picks(df: DataFrame, keys: Sequence[str], slice_col: str, micros: str, position: str, gap: int,
                 starts: Column | None = None) -> DataFrame:
    """Add ``picked``: the first row, then each first row at least ``gap`` microseconds after
    the last picked one.

    A row ``gap`` or more behind its predecessor is always picked, so the key falls into
    independent pieces that begin at such rows. ``starts`` replaces that test where the walk
    also begins anew for other reasons. Only rows ``gap`` or more behind the start of their
    piece need the ordered walk.
    """
    keys = list(keys)
    order = [F.col(position)]
    if starts is None:
        df_in = running(df, keys, slice_col, order, {"_before": Scan("max", F.col(micros), inclusive=False)})
        starts = F.coalesce(F.col(micros) - F.col("_before") >= gap, F.lit(True))
    else:
        df_in = df
    pieces = cut(running(df_in, keys, slice_col, order, {
        "_piece": Scan("max", F.when(starts, F.struct(F.col(position).alias("at"), F.col(micros).alias("since"))))}), "pieces")
    again = _walk_pieces(pieces, keys, slice_col, micros, position, gap)
    return (keyed_join(pieces, again, [*keys, position], "left")
            .withColumn("picked", (F.col("_piece.at") == F.col(position)) | F.coalesce("_again", F.lit(False)))
            .select(*df.columns, "picked"))


def _walk_pieces(pieces: DataFrame, keys: list[str], slice_col: str, micros: str, position: str, gap: int) -> DataFrame:
    """Positions picked after the start of their piece.

    Rows are folded per (piece, slice), so a fold never sees more than one slice. What a slice
    does depends only on the last pick before it; that is known at once for a piece inside one
    slice, and comes from ``_entries`` for the long ones.
    """
    late = pieces.where(F.col(micros) - F.col("_piece.since") >= gap).select(
        *keys, F.col("_piece.at").alias("_at"), F.col("_piece.since").alias("_since"), slice_col,
        F.col(position).cast("bigint").alias("_p"), F.col(micros).alias("_m"))
    piece = [*keys, "_at", "_since"]
    folded = late.groupBy(*piece, slice_col).agg(F.array_sort(F.collect_list(F.struct("_p", "_m"))).alias("_rows"))
    spans = folded.groupBy(*piece).agg(F.count("*").alias("_slices")).where(F.col("_slices") > 1)
    entries = _entries(keyed_join(folded, spans, piece), piece, slice_col, gap)
    picked = keyed_join(folded, entries, [*piece, slice_col], "left").withColumn("_last", F.coalesce("_last", "_since"))
    types = {f.name: f.dataType.simpleString() for f in picked.schema}
    ddl = ", ".join(f"`{c}` {types[c]}" for c in keys)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Follow, from the entry, each row to the first one ``gap`` later: one step per pick."""
        for pdf in batches:
            out = []
            for rows, last in zip(pdf["_rows"], pdf["_last"]):
                times = np.fromiter((r["_m"] for r in rows), np.int64, len(rows))
                step, at, picks = np.searchsorted(times, times + gap).tolist(), int(np.searchsorted(times, last + gap)), []
                while at < len(step):
                    picks.append(int(rows[at]["_p"]))
                    at = step[at]
                out.append(picks)
            yield pdf[keys].assign(_picks=out)
    walked = picked.select(*keys, "_rows", "_last").mapInPandas(walk, f"{ddl}{', ' if keys else ''}_picks array<bigint>")
    return walked.select(*keys, F.explode("_picks").alias(position)).withColumn("_again", F.lit(True))


def _entries(folded: DataFrame, piece: list[str], slice_col: str, gap: int) -> DataFrame:
    """Last pick before each slice of the pieces that cross slices; ``_slices`` has their number in the piece.

    Each slice is summed up, in parallel, as a table from the possible entry times (its first
    ``gap``) to its last pick. The tables of a piece of up to ``FOLLOWED`` slices are followed in one group; in a longer piece
    the entries that the walk takes are found by pointer doubling, where no step sees more than one entry.
    """
    types = {f.name: f.dataType.simpleString() for f in folded.schema}
    ddl = ", ".join(f"`{c}` {types[c]}" for c in [*piece, slice_col, "_slices"])

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            entry, leave = [], []
            for rows in pdf["_m"]:
                times = np.asarray(rows, dtype=np.int64)
                step = np.searchsorted(times, times + gap)
                final = np.arange(len(times))
                for i in range(len(times) - 1, -1, -1):
                    if step[i] < len(times):
                        final[i] = final[step[i]]
                ways = int(np.searchsorted(times, times[0] + gap)) + 1
                entry.append(times[:ways].tolist())
                leave.append(times[final[:ways]].tolist())
            out = pdf[[*piece, slice_col, "_slices"]].copy()
            out["_entry"], out["_exit"] = entry, leave
            yield out

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(slice_col)
        last, begun = int(pdf["_since"].iloc[0]), []
        for entry, leave in zip(pdf["_entry"], pdf["_exit"]):
            begun.append(last)
            at = int(np.searchsorted(np.asarray(entry), last + gap))
            if at < len(entry):
                last = int(leave[at])
        out = pdf[[*piece, slice_col]].copy()
        out["_last"] = begun
        return out
    times = folded.select(*piece, slice_col, "_slices", F.transform("_rows", lambda r: r["_m"]).alias("_m"))
    summed = cut(times.mapInPandas(tables, f"{ddl}, _entry array<bigint>, _exit array<bigint>"), "transfer")
    short = ", ".join(f"`{c}` {types[c]}" for c in [*piece, slice_col])
    followed = summed.where(F.col("_slices") <= FOLLOWED).groupBy(*piece).applyInPandas(follow, f"{short}, _last bigint")
    longest = summed.agg(F.max("_slices")).first()[0] or 0
    if longest <= FOLLOWED:
        return followed
    tabled = summed.where(F.col("_slices") > FOLLOWED)
    nodes = tabled.select(*piece, slice_col, F.explode(F.array_distinct(F.arrays_zip("_entry", "_exit"))).alias("_x")).select(
        *piece, F.struct(F.col("_x._entry").alias("t"), F.col(slice_col).alias("s")).alias("_n"), F.col("_x._exit").alias("_out"))
    taken = _reached(nodes, piece, gap, longest).select(*piece, F.col("_n.s").alias(slice_col), (F.col("_n.t") - gap).alias("_last"))
    # a slice without a taken entry has no pick: its walk starts behind all times
    begun = keyed_join(tabled.select(*piece, slice_col), taken, [*piece, slice_col], "left")
    return followed.unionByName(begun.withColumn("_last", F.coalesce("_last", F.lit(1 << 62))))


def _reached(nodes: DataFrame, piece: list[str], gap: int, slices: int) -> DataFrame:
    """Entries ``_n`` (time and slice) of each piece that the walk from its first entry comes to, one a slice at most.

    An entry leads to the first entry at least ``gap`` after the pick ``_out`` it leaves its slice with. With the pointers that
    span 2**k entries, the reached ones double each round, so a piece of n slices takes log2(n) rounds of equi-joins on (piece, entry).
    """
    kind = nodes.schema["_n"].dataType
    row = lambda time, kind_, from_, entry: [*piece, time.alias("_t"), F.lit(kind_).alias("_kind"), from_.cast(kind).alias("_n"), entry.cast(kind).alias("_entry")]
    none = F.lit(None)
    points = nodes.select(*row(F.col("_out") + gap, 0, F.col("_n"), none)).unionByName(nodes.select(*row(F.col("_n.t"), 1, none, F.col("_n"))))
    sought = running(points.withColumn("_wide", F.floor(F.col("_t") / (gap * 1024)).cast("bigint")), piece, "_wide",
                     [F.col("_t"), F.col("_kind")], {"_to": Scan("min", F.col("_entry"), backward=True)})
    jumps = cut(sought.where((F.col("_kind") == 0) & F.col("_to").isNotNull()).select(*piece, "_n", "_to"), "jumps")
    reached = cut(nodes.groupBy(*piece).agg(F.min("_n").alias("_n")), "reached")
    for _ in range(max(1, slices - 1).bit_length()):
        ahead = keyed_join(reached, jumps, [*piece, "_n"]).select(*piece, F.col("_to").alias("_n"))
        reached = cut(reached.unionByName(ahead), "reached")
        onward = jumps.select(*piece, F.col("_n").alias("_to"), F.col("_to").alias("_far"))
        jumps = cut(keyed_join(jumps, onward, [*piece, "_to"]).select(*piece, "_n", F.col("_far").alias("_to")), "jumps")
    return reached
