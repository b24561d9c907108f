"""Sharding by histogram sort (operator 2), DataFrame operations only.

Rows get a key of three longs: hash of the text, hash of the doc_id, and a row number kept in the written key table.
Equal texts are neighbours in key order, so a shard boundary falls inside a group of equal texts only where the group
is larger than the tolerance. Each round counts, over all partitions, the exact bytes between evenly spaced probes of
the intervals that still hold a splitter, and keeps for each splitter the cell that its target falls in. Rounds end
when every splitter is within the tolerance or its cell has one row. Then rows are exchanged once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table, text_or_empty, written

#: Probes of one interval in one round.
PROBES = 256
LEVELS = 3


@dataclass(frozen=True)
class Interval:
    """Rows whose first `level` key parts equal `fixed` and whose next part is from lo to hi; `below` bytes precede it."""

    level: int
    fixed: tuple[int, ...]
    lo: int
    hi: int
    below: int
    rows: int


def _keys(names: list[str]) -> list[Column]:
    return [F.col(n) for n in names]


def _inside(names: list[str], it: Interval) -> Column:
    parts = [k == F.lit(v) for k, v in zip(_keys(names), it.fixed, strict=False)]
    return reduce(lambda a, b: a & b, [*parts, F.col(names[it.level]).between(it.lo, it.hi)])


def _step(it: Interval) -> int:
    return (it.hi - it.lo) // PROBES + 1


def count_below(keyed: DataFrame, names: list[str], size: str, intervals: list[Interval]) -> dict:
    """(interval, cell) -> (bytes, rows, least, greatest): sums of each partition first, then of all."""
    which = cell = part = F
    for i, it in enumerate(intervals):
        inside, key = _inside(names, it), F.col(names[it.level])
        which = which.when(inside, F.lit(i))
        cell = cell.when(inside, F.expr(f"({names[it.level]} - {it.lo}L) div {_step(it)}L"))
        part = part.when(inside, key)
    found = (
        keyed.select(which.alias("i"), cell.alias("cell"), part.alias("part"), F.col(size).alias("size"))
        .where("i IS NOT NULL")
        .groupBy("i", "cell")
        .agg(F.sum("size"), F.count("*"), F.min("part"), F.max("part"))
        .collect()  # at most PROBES rows for each splitter
    )
    return {(r[0], r[1]): tuple(r[2:]) for r in found}


def splitters(keyed: DataFrame, names: list[str], size: str, n: int, tolerance: float) -> tuple[list[tuple], int]:
    """n - 1 splitters (level, key parts): a row is past one if its parts are greater than the splitter's."""
    total, rows, lo, hi = keyed.agg(F.sum(size), F.count("*"), F.min(names[0]), F.max(names[0])).first()
    if not rows:
        return [], 0
    slack = tolerance * total / n
    at = {j: Interval(0, (), lo, hi, 0, rows) for j in range(1, n)}
    done: dict[int, tuple] = {}
    while len(done) < n - 1:
        active = sorted({at[j] for j in at if j not in done}, key=lambda i: (i.below, i.level))
        cells = count_below(keyed, names, size, active)
        for j in [j for j in at if j not in done]:
            it, target, below = at[j], total * j / n, at[j].below
            mine = sorted((c, v) for (i, c), v in cells.items() if active[i] == it)
            for k, (_, (bytes_, count, least, most)) in enumerate(mine):
                if below + bytes_ >= target or k == len(mine) - 1:
                    break
                below += bytes_
            before, after = target - below, below + bytes_ - target
            if min(before, after) <= slack or count == 1:
                # Before the cell: the greatest key of what precedes it; or else the cell's own greatest key.
                done[j] = (*it.fixed, least - 1) if before < after else (*it.fixed, most)
            elif least < most:
                at[j] = Interval(it.level, it.fixed, least, most, below, count)
            elif it.level + 1 < LEVELS:
                fixed = (*it.fixed, least)
                at[j] = Interval(it.level + 1, fixed, *_extent(keyed, names, fixed), below, count)
            else:
                done[j] = (*it.fixed, most)
    return [done[j] for j in sorted(done)], total


def _extent(keyed: DataFrame, names: list[str], fixed: tuple[int, ...]) -> tuple[int, int]:
    same = reduce(lambda a, b: a & b, [F.col(n) == F.lit(v) for n, v in zip(names, fixed, strict=False)])
    part = names[len(fixed)]
    return tuple(keyed.where(same).agg(F.min(part), F.max(part)).first())


def _past(names: list[str], splitter: tuple[int, ...]) -> Column:
    """Whether a row's key is past the splitter, by its parts in order."""
    past = F.col(names[len(splitter) - 1]) > F.lit(splitter[-1])
    for name, v in reversed(list(zip(names, splitter[:-1], strict=False))):
        past = (F.col(name) > F.lit(v)) | ((F.col(name) == F.lit(v)) & past)
    return past


def shard(
    docs: DataFrame,
    n_shards: int = 16,
    tolerance: float = 0.002,
    payload: list[Column] | None = None,
    block_rows: int = 1_000_000,
) -> DataFrame:
    """docs (or the payload columns of it) with size, shard and slot; shards differ little in bytes.

    size is the text's UTF-8 bytes (null: 0) plus 1. `tolerance` is of a shard's mean size; where one row is larger,
    the boundary is the nearer end of that row. Slots of a shard run gapless from 0, over blocks of about block_rows
    rows so that no task takes a whole shard. Repeated rows are told apart by their row number, so a third of all
    rows may be one document. An empty table gives an empty result. Columns named as the results are replaced.
    """
    names = [fresh(docs, f"key_{k}") for k in "abc"]
    width, place, block, start, row = (fresh(docs, f"shard_{k}") for k in ("size", "no", "block", "start", "row"))
    text = text_or_empty()
    out = payload or _keys(docs.columns)
    mine = {"size", "shard", "slot"}
    base = docs.select(
        *out,
        (F.octet_length(text) + 1).cast("long").alias(width),
        F.xxhash64(text).alias(names[0]),
        F.xxhash64(F.col("doc_id"), F.lit(1)).alias(names[1]),
        F.monotonically_increasing_id().alias(names[2]),
    )
    # Halved, so that differences of key parts fit in a long.
    base = base.withColumns({n: F.shiftright(F.col(n), 1) for n in names[:2]})
    keyed = written(base, "shard-keys")
    cuts, total = splitters(keyed, names, width, n_shards, tolerance)
    number = reduce(lambda a, b: a + b, [_past(names, c).cast("int") for c in cuts], F.lit(0))
    placed = keyed.withColumn(place, number)
    rows = keyed.count()
    blocks = max(1, -(-rows // (n_shards * block_rows)))
    placed = placed.withColumn(block, F.pmod(F.xxhash64(*_keys(names)), F.lit(blocks)))
    # At most n_shards rows for each block_rows * n_shards rows of input.
    counts = {(r[0], r[1]): r[2] for r in placed.groupBy(place, block).count().collect()}
    starts, at = [], {}
    for s, b in sorted(counts):
        starts.append((s, b, at.get(s, 0)))
        at[s] = at.get(s, 0) + counts[s, b]
    offsets = docs.sparkSession.createDataFrame(starts, f"{place} int, {block} long, {start} long")
    ordered = placed.withColumn(
        row, F.expr(f"row_number() OVER (PARTITION BY {place}, {block} ORDER BY {', '.join(names)})")
    )
    keep = [c for c in keyed.columns if c not in names and c != width and c.lower() not in mine]
    return ordered.join(F.broadcast(offsets), [place, block]).select(
        *keep,
        F.col(width).alias("size"),
        F.col(place).alias("shard"),
        (F.col(start) + F.col(row) - 1).alias("slot"),
    )


def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    payload = [F.col("doc_id"), F.crc32(text_or_empty().cast("binary")).alias("text_crc32")]
    return shard(docs, payload=payload).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
