"""What encodings and sizes are chosen from: facts of each physical column of each row group.

Rows are handed over in Arrow batches and counted column by column, so a row stays a row however many columns it has,
and a plan has the same few steps for ten columns as for ten thousand. Distinct values are kept up to the largest
dictionary only: what has more is counted no further.

Where row groups are long runs of rows, each is counted by itself. Where rows of many groups lie mixed, batches are put
together and all groups of a column are counted at once, so the time goes with the rows, not with groups times batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from ..types import is_nanos, width

#: Cells of one Arrow batch, and (row group, column) pairs and their values that a task holds before it hands them on.
BATCH_CELLS, HELD, HELD_VALUES = 4_000_000, 200_000, 2_000_000
#: Rows of a row group in a batch from which it is counted by itself, and bytes of mixed batches that are put together.
LONG, MIXED_BYTES = 1000, 64 << 20


def shred(arr: pa.Array, t: T.DataType, groups: np.ndarray | None) -> Iterator[tuple[pa.Array, T.DataType, np.ndarray | None]]:
    """The physical columns of a column's values, depth first: lengths (null for a null), then children.

    Children of null values are dropped, a map's keys come before its values. groups: a number for each value, or None;
    children have their parent's.
    """
    if isinstance(t, (T.ArrayType, T.MapType)):
        arr = _as_list(arr) if isinstance(t, T.MapType) else arr
        lengths = pc.list_value_length(arr)
        yield lengths, T.IntegerType(), groups
        valid = arr.is_valid()
        entries = arr.filter(valid).flatten()
        if groups is not None:
            groups = np.repeat(groups[valid.to_numpy(zero_copy_only=False)], lengths.drop_null().to_numpy())
        if isinstance(t, T.ArrayType):
            yield from shred(entries, t.elementType, groups)
        else:
            keys, values = entries.flatten()  # of structs
            yield from shred(keys, t.keyType, groups)
            yield from shred(values, t.valueType, groups)
    else:
        yield arr, t, groups


def _as_list(arr: pa.MapArray) -> pa.Array:
    return arr.cast(pa.list_(pa.struct([("key", arr.type.key_type), ("value", arr.type.item_type)])))


def names_of(name: str, t: T.DataType) -> list[tuple[str, T.DataType]]:
    """Names and types of the physical columns, in the order of `shred`."""
    if isinstance(t, T.ArrayType):
        return [(name, T.IntegerType()), *names_of(f"{name}.element", t.elementType)]
    if isinstance(t, T.MapType):
        return [(name, T.IntegerType()), *names_of(f"{name}.key", t.keyType), *names_of(f"{name}.value", t.valueType)]
    return [(name, t)]


def _prefix(n: np.ndarray) -> np.ndarray:
    """Bytes of a length prefix of seven bits a byte."""
    return 1 + sum((n >= 1 << s).astype(np.int64) for s in (7, 14, 21, 28))


def _unscaled_bytes(arr: pa.Array) -> np.ndarray:
    """Bytes of each decimal's unscaled value in two's complement, as few as hold it."""
    words = np.frombuffer(arr.buffers()[1], np.int64).reshape(-1, 2)[arr.offset : arr.offset + len(arr)]
    sign = words[:, 1] >> 63
    low, high = (words ^ sign[:, None]).view(np.uint64).T
    one = np.uint64(1)
    n = 1 + sum(((high > 0) | (low >= one << np.uint64(8 * k - 1))).astype(np.int64) for k in range(1, 9))
    return n + sum((high >= one << np.uint64(8 * k - 1)).astype(np.int64) for k in range(1, 8))


def stored_sizes(arr: pa.Array, t: T.DataType) -> np.ndarray:
    """Bytes of each of the values (none is null) of a kind of varying width."""
    n = _unscaled_bytes(arr) if isinstance(t, T.DecimalType) else pc.binary_length(arr).to_numpy(zero_copy_only=False)
    n = n.astype(np.int64)
    return _prefix(n) + n


def _bits(arr: pa.Array, t: T.DataType) -> pa.Array:
    """The same values, told apart by their bytes: 0.0 and -0.0 differ, and so do kinds of NaN."""
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return arr.view(pa.int32() if isinstance(t, T.FloatType) else pa.int64())
    if is_nanos(t):
        millis, nanos = (x.to_numpy(zero_copy_only=False) for x in arr.flatten())
        both = np.empty(len(arr), [("m", "<i8"), ("n", "<i4")])
        both["m"], both["n"] = millis, nanos
        return pa.FixedSizeBinaryArray.from_buffers(pa.binary(12), len(arr), [None, pa.py_buffer(both.tobytes())])
    return arr


def _raw(values: pa.Array) -> pa.Array:
    """Bytes that are equal exactly where the values (of `_bits`) are."""
    t = values.type
    if pa.types.is_temporal(t):
        values = values.view(pa.int32() if t.bit_width == 32 else pa.int64())
    if pa.types.is_boolean(t):
        values = values.cast(pa.int8())
    if not (pa.types.is_binary(t) or pa.types.is_large_binary(t) or pa.types.is_fixed_size_binary(t) or pa.types.is_large_string(t)):
        values = values.cast(pa.string())
    return values.cast(pa.binary())


class Fact:
    """Counts of one physical column in one row group; values maps distinct values to their sizes, None if too many."""

    __slots__ = ("non_null", "plain", "rows", "values")

    def __init__(self):
        self.rows = self.non_null = self.plain = 0
        self.values: dict[bytes, int] | None = {}

    def add(self, arr: pa.Array, t: T.DataType, most: int) -> None:
        self.rows += len(arr)
        if arr.null_count:
            arr = arr.filter(arr.is_valid())
        self.non_null += len(arr)
        w = width(t)
        self.plain += len(arr) * w if w is not None else int(stored_sizes(arr, t).sum())
        if self.values is None or not len(arr):
            return
        found = pc.unique(_bits(arr, t))
        if len(found) <= most:
            sizes = [w] * len(found) if w is not None else stored_sizes(found, t).tolist()
            self.values.update(zip(_raw(found).to_pylist(), sizes, strict=True))
        if len(found) > most or len(self.values) > most:
            self.values = None


def by_group(b: pa.RecordBatch) -> Iterator[tuple[object, pa.RecordBatch]]:
    """(group, its rows) of a batch by its first column: sorted once, then cut."""
    groups = b.column(0).dictionary_encode(null_encoding="encode")
    names = groups.dictionary.to_pylist()
    if len(names) == 1:
        yield names[0], b
        return
    codes = groups.indices.to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.bincount(codes, minlength=len(names)))
    ordered = b.take(pa.array(np.argsort(codes, kind="stable")))
    for g, start, end in zip(names, [0, *ends[:-1]], ends, strict=True):
        yield g, ordered.slice(start, end - start)


#: A row has the counts of a column, or one of its distinct values.
FACTS = "column_no int, rows long, non_null long, plain_bytes long, many boolean, entry binary, entry_size int"
_FACT_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int32())


def _facts(groups: pa.Array, row_group: str, **given: pa.Array) -> pa.RecordBatch:
    """A batch of FACTS; what is not given is null."""
    types = dict(zip((x.split()[0] for x in FACTS.split(", ")), _FACT_TYPES, strict=True))
    made = [given[n].cast(t) if n in given else pa.nulls(len(groups), t) for n, t in types.items()]
    return pa.RecordBatch.from_arrays([groups, *made], [row_group, *types])


def _of_groups(
    arr: pa.Array, t: T.DataType, codes: np.ndarray, names: pa.Array, k: int, most: int, row_group: str
) -> Iterator[pa.RecordBatch]:
    """FACTS of all row groups of a physical column at once; codes has the place of each value's group in names."""
    n, w = len(names), width(t)
    rows = np.bincount(codes, minlength=n)
    if arr.null_count:
        codes = codes[arr.is_valid().to_numpy(zero_copy_only=False)]
        arr = arr.drop_null()
    non_null = np.bincount(codes, minlength=n)
    if w is not None:
        plain = non_null * w
    else:  # of whole numbers well below 2**53
        plain = np.bincount(codes, weights=stored_sizes(arr, t), minlength=n).astype(np.int64)
    found = _bits(arr, t).dictionary_encode()
    pairs = pd.unique(codes * np.int64(len(found.dictionary)) + found.indices.to_numpy(zero_copy_only=False))
    of, value = np.divmod(pairs, max(1, len(found.dictionary)))
    many = np.bincount(of, minlength=n) > most
    kept = ~many[of]
    of, (used, value) = of[kept], np.unique(value[kept], return_inverse=True)
    own = found.dictionary.take(pa.array(used))
    sizes = np.full(len(used), w) if w is not None else stored_sizes(own, t)
    counts = {"rows": rows, "non_null": non_null, "plain_bytes": plain, "many": many}
    number = pa.scalar(k, pa.int32())
    # Also of groups without a value here, which a child may lack.
    yield _facts(names, row_group, column_no=pa.repeat(number, n), **{x: pa.array(v) for x, v in counts.items()})
    if len(of):
        yield _facts(names.take(pa.array(of)), row_group, column_no=pa.repeat(number, len(of)), entry=_raw(own).take(pa.array(value)), entry_size=pa.array(sizes[value]))


def column_facts(df: DataFrame, columns: list[str], buckets: dict[str, int], most: int, row_group: str) -> DataFrame:
    """(row_group, parent, column, child, bucket, short, rows, non_null, plain_bytes, distinct, entry_bytes).

    A row for each physical column; parent is the table's column. distinct and entry_bytes are null above `most` values.
    A group that is written as a file is counted in one task or a few; each hands on `most` values of a column at most.
    """
    spark, kinds = df.sparkSession, [(n, df.schema[n].dataType) for n in columns]
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    fits = max(64, BATCH_CELLS // max(1, len(columns)))
    if int(spark.conf.get(key, "10000")) > fits:  # tables of hundreds of columns and more
        spark.conf.set(key, str(fits))
    plan = [(parent, n, n_t) for parent, t in kinds for n, n_t in names_of(parent, t)]
    first = {}
    for k, (parent, _, _) in enumerate(plan):
        first.setdefault(parent, k)

    def out(held: dict, group_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        """Counts, then values, of the groups that are held; row by row of `held`."""
        facts = [f for of in held.values() for f in of]
        k = np.tile(np.arange(len(plan)), len(held))
        names = pa.array(list(held), group_type).take(pa.array(np.repeat(np.arange(len(held)), len(plan))))
        counts = {n: pa.array([getattr(f, a) for f in facts], pa.int64()) for n, a in (("rows", "rows"), ("non_null", "non_null"), ("plain_bytes", "plain"))}
        yield _facts(names, row_group, column_no=pa.array(k), many=pa.array([f.values is None for f in facts]), **counts)
        n = np.array([len(f.values or ()) for f in facts], np.int64)
        value = pa.array([v for f in facts for v in f.values or ()], pa.binary())
        size = pa.array([s for f in facts for s in (f.values or {}).values()], pa.int32())
        at = np.repeat(np.arange(len(facts)), n)
        yield _facts(names.take(pa.array(at)), row_group, column_no=pa.array(k[at]), entry=value, entry_size=size)

    def mixed(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (b,) = pa.Table.from_batches(batches).combine_chunks().to_batches()
        groups = b.column(0).dictionary_encode(null_encoding="encode")
        codes, names, k = groups.indices.to_numpy().astype(np.int64), groups.dictionary, 0
        for no, (_, t) in enumerate(kinds):
            for arr, own, of in shred(b.column(no + 1), t, codes):
                yield from _of_groups(arr, own, of, names, k, most, row_group)
                k += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, values, waiting, group_type = {}, 0, [], None
        for b in batches:
            if not len(b):
                continue
            group_type = b.schema.field(0).type
            n = len(pc.unique(b.column(0)))
            if n > 1 and len(b) < n * LONG:
                waiting.append(b)
                if sum(map(len, waiting)) * len(b.columns) >= BATCH_CELLS or sum(x.nbytes for x in waiting) >= MIXED_BYTES:
                    yield from mixed(waiting)
                    waiting = []
                continue
            for g, part in by_group(b):
                facts = held.setdefault(g, [Fact() for _ in plan])
                physical = (x for no, (_, t) in enumerate(kinds) for x in shred(part.column(no + 1), t, None))
                for f, (arr, own, _) in zip(facts, physical, strict=True):
                    before = len(f.values or ())
                    f.add(arr, own, most)
                    values += len(f.values or ()) - before
            if len(held) * len(plan) > HELD or values > max(HELD_VALUES, most * len(plan)):
                yield from out(held, group_type)
                held, values = {}, 0
        if waiting:
            yield from mixed(waiting)
        if held:
            yield from out(held, group_type)

    kind = df.schema[row_group].dataType.simpleString()
    escaped = "`" + row_group.replace("`", "``") + "`"
    chosen = df.select(F.col(escaped), *[F.col("`" + n.replace("`", "``") + "`") for n in columns])
    told = chosen.mapInArrow(run, f"{escaped} {kind}, {FACTS}")
    # All of a group's column meets in one partition: at most `most` values of each task's share, counted by hash.
    each = told.repartition(F.col(escaped), "column_no").groupBy(escaped, "column_no", "entry").agg(
        F.sum("rows").alias("rows"), F.sum("non_null").alias("non_null"), F.sum("plain_bytes").alias("plain_bytes"),
        F.bool_or("many").alias("many"), F.max("entry_size").alias("entry_size"),
    )
    met = each.groupBy(escaped, "column_no").agg(
        F.sum("rows").alias("rows"), F.sum("non_null").alias("non_null"), F.sum("plain_bytes").alias("plain_bytes"),
        F.bool_or("many").alias("many"), F.count("entry").alias("n"), F.coalesce(F.sum("entry_size"), F.lit(0)).cast("long").alias("total"),
    )
    known = [(k, p, n, first[p] != k, buckets.get(p), (width(t) or 99) <= 8) for k, (p, n, t) in enumerate(plan)]
    named = spark.createDataFrame(known, "column_no int, parent string, column string, child boolean, bucket int, short boolean")
    few = ~F.col("many") & (F.col("n") <= most)
    return met.join(F.broadcast(named), "column_no").select(
        escaped, "parent", "column", "child", "bucket", "short", "rows", "non_null", "plain_bytes",
        F.when(few, F.col("n")).alias("distinct"), F.when(few, F.col("total")).alias("entry_bytes"),
    )
