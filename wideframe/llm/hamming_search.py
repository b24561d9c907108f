"""Exact top-k search over binary codes (operator 10): incremental multi-index hashing.

A vector's code is its sign bits. The index holds each distinct code once for each of its segments, with the least ids
that share the code. A round probes, for each query that is still open, the segment values at exactly that round's
radius. After the round of radius r every code within m*(r+1)-1 of the query has been met (m segments: one of them is
within r), so a query closes once its kth verified distance is not above that. A pair counts only in the round and
segment where it is first met, and only if it is not farther than the kth distance so far, so no pair comes twice.

Segments are as wide as the number of codes makes worth while. Where a radius of wide segments would list too many
values, the queries that are still open go on with segments of half the width, whose radii are smaller; the narrowest
ones reach every code. So every pair is met by an equal segment value, never by comparing all with all.

What a join broadcasts is counted first, for Spark takes listed probes for as few as their queries. An index of more than
BROADCAST_ROWS is met piece by piece: a segment of a part of the codes, whose parts are dealt by their hash.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Rows that may be broadcast at once: ids of an index (in each of a code's segments), about 130 bytes each in a hash
#: table, or listed probes. 0: none, joins are merged.
BROADCAST_ROWS = 300_000
#: Probes of one radius that are listed; where a segment has more, open queries go on with narrower segments.
MAX_PROBES = 40_000
#: Widths of a segment in bits, and up to how many codes each is the first.
WIDTHS = ((8, 1 << 12), (16, 1 << 24), (32, 1 << 62))


def code_words(vector: str, words: int) -> list[Column]:
    """Longs of 64 sign bits each: 1 where an element is above 0, else 0; so for nulls and past the vector's end."""

    def word(k: int) -> Column:
        part = F.slice(vector, 64 * k + 1, 64)
        bits = F.concat(part, F.array_repeat(F.lit(None).cast("double"), 64 - F.size(part)))
        return F.aggregate(
            bits,
            F.lit(0).cast("long"),
            lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.coalesce((x > 0).cast("long"), F.lit(0).cast("long"))),
        )

    return [word(k) for k in range(words)]


def _names(prefix: str, words: int) -> list[str]:
    return [f"{prefix}{k}" for k in range(words)]


def _segment(word: Column, bits: int, j: int) -> Column:
    mask = (1 << bits) - 1
    return F.shiftrightunsigned(word, bits * j).bitwiseAND(F.lit(mask).cast("long"))


def _distance(a: list[str], b: list[str]) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(F.col(p).bitwiseXOR(F.col(q))) for p, q in zip(a, b, strict=True)])


def masks(bits: int, radius: int) -> list[int]:
    return [sum(1 << i for i in c) for c in combinations(range(bits), radius)]


def _count(bits: int, radius: int) -> int:
    return reduce(lambda n, i: n * (bits - i) // (i + 1), range(radius), 1)


def _least_ids(rows: DataFrame, by: list[str], order: str, k: int) -> DataFrame:
    """The first k rows of each group: each task keeps k of a group before the exchange."""
    return rows.withColumn("nth", F.expr(f"row_number() OVER (PARTITION BY {', '.join(by)} ORDER BY {order})")).where(
        f"nth <= {k}"
    )


def _segments(names: list[str], bits: int) -> list[tuple[int, Column]]:
    """(number, value) of each segment of a code's words."""
    per_word = 64 // bits
    return [(w * per_word + j, _segment(F.col(names[w]), bits, j)) for w in range(len(names)) for j in range(per_word)]


def _pieces(n: int, m: int, probes: int) -> tuple[str, list[tuple[list[int], int, int]]]:
    """(the side that is broadcast, or none; (segments, part of the codes, number of parts) of each piece of the index)."""
    whole = [(list(range(m)), 0, 1)]
    if n * m <= BROADCAST_ROWS:
        return "index", whole
    if probes <= BROADCAST_ROWS:
        return "probes", whole
    if not BROADCAST_ROWS:
        return "", whole
    parts = -(-n // BROADCAST_ROWS)
    return "index", [([j], part, parts) for j, part in product(range(m), range(parts))]


def _rounds(
    codes: DataFrame, state: DataFrame, best: DataFrame | None, bits: int, words: int, kept: int, n: int
) -> tuple[DataFrame, DataFrame | None]:
    """Rounds with segments of so many bits: (queries still open, what was found). What open queries found before is
    found again, so it is dropped first; their kth distance stays a bound. n: ids of all codes."""
    c, q = _names("c", words), _names("q", words)
    m = words * 64 // bits

    def entries(names: list[str], js: list[int], value: str) -> Column:
        return F.explode(F.array(*[F.struct(F.lit(j).alias("j"), v.alias(value)) for j, v in _segments(names, bits) if j in js]))

    state = written(state, "search-open")
    if best is not None:
        best = written(best.join(state.select(*q), q, "left_anti"), "search-closed")
    spark = codes.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    radius = 0
    while radius <= bits and _count(bits, radius) <= MAX_PROBES and (still := state.count()):
        listed = F.split(F.lit(",".join(map(str, masks(bits, radius)))), ",").cast("array<bigint>")
        # Met here first: no segment is nearer than the radius, nor one before this as near.
        first = F.lit(True)
        apart = [(j, F.bit_count(a.bitwiseXOR(b))) for (j, a), (_, b) in zip(_segments(q, bits), _segments(c, bits), strict=True)]
        for j, d in apart:
            first = first & F.when(F.col("l.j") > j, d > radius).otherwise(d >= radius)
        side, pieces = _pieces(n, m, still * m * _count(bits, radius))
        for js, part, parts in pieces:
            # Queries are few and their probes many: each query's segments are dealt over all tasks before they are listed.
            probes = state.select(*q, "kth", entries(q, js, "own").alias("e")).select(*q, "kth", "e.*").repartition(tasks, *q, "j")
            probes = probes.select(*q, "kth", "j", "own", F.explode(listed).alias("flip"))
            probes = probes.withColumn("value", F.expr("own ^ flip"))
            own = codes if parts == 1 else codes.where(F.expr(f"pmod(xxhash64({', '.join(c)}), {parts}) = {part}"))
            index = own.select("*", entries(c, js, "value").alias("e")).select(*c, "ids", "e.*")
            probes = probes.hint("broadcast") if side == "probes" else probes
            index = index.hint("broadcast" if side == "index" else "merge") if side != "probes" else index
            met = F.col("l.value") == F.col("r.value")
            met = met if len(js) == 1 else met & (F.col("l.j") == F.col("r.j"))
            near = probes.alias("l").join(index.alias("r"), met & (_distance(q, c) <= F.col("kth")) & first)
            found = near.select(*q, _distance(q, c).alias("distance"), F.explode("ids").alias("id"))
            merged = found if best is None else best.union(found)
            best = written(_least_ids(merged, q, "distance, id", kept).drop("nth"), "search-best")
        sure = m * (radius + 1) - 1
        held = best.groupBy(*q).agg(F.count("*").alias("n"), F.max("distance").alias("far"))
        reached = F.least(F.col("kth"), F.when(F.col("n") >= kept, F.col("far")).otherwise(64 * words))
        # Once every code is within reach, queries with fewer rows than asked for are done too.
        state = state.join(held, q, "left").select(*q, reached.alias("kth")).where((F.col("kth") > sure) & F.lit(sure < 64 * words))
        state = written(state, "search-open")
        radius += 1
    return state, best


def top_k(
    base: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vector: str = "embedding",
    with_self: bool = False,
) -> DataFrame:
    """query_id, rank (from 1), the id column, distance: the k rows of `base` nearest by Hamming distance of sign bits.

    Ties go to the lesser id. A query's own id is left out unless with_self. Rows with a null id or vector are neither
    searched nor found; where base has fewer than k other rows, all are given. Repeated ids count as rows of their own
    for base, once for queries with one code. Empty tables give an empty result.
    """
    widest = base.select(F.size(vector).alias("n")).union(queries.select(F.size(vector))).agg(F.max("n")).first()[0]
    words = max(1, -(-(widest or 1) // 64))
    c, q = _names("c", words), _names("q", words)
    clean = f"{id_col} IS NOT NULL AND {vector} IS NOT NULL"

    def coded(df: DataFrame, names: list[str]) -> DataFrame:
        made = [w.alias(n) for w, n in zip(code_words(vector, words), names, strict=True)]
        return df.where(clean).select(F.col(id_col).alias("id"), *made)

    kept = k if with_self else k + 1
    # A code's first ids: no result needs more of them than that.
    codes = written(
        _least_ids(coded(base, c), c, "id", kept).groupBy(*c).agg(F.sort_array(F.collect_list("id")).alias("ids")),
        "search-codes",
    )
    asked = written(coded(queries, q), "search-queries")
    n, n_ids = codes.agg(F.count("*"), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
    spare = f"query_id bigint, rank int, {id_col} bigint, distance int"
    if not n or asked.isEmpty():
        return base.sparkSession.createDataFrame([], spare)
    state = asked.select(*q).distinct().withColumn("kth", F.lit(64 * words))
    best = None
    widest_no = next(k for k, (_, most) in enumerate(WIDTHS) if n <= most)
    for bits, _ in reversed(WIDTHS[: widest_no + 1]):
        state, best = _rounds(codes, state, best, bits, words, kept, n_ids)
        if state.isEmpty():
            break
    mine = asked.distinct().withColumnRenamed("id", "query_id").join(best, q)
    mine = mine if with_self else mine.where("id <> query_id")
    ranked = _least_ids(mine, ["query_id", *q], "distance, id", k)
    return ranked.select("query_id", F.col("nth").alias("rank"), F.col("id").alias(id_col), "distance")


def op10_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(rows, rows.where("vec_id % 20 = 0"))


SQL = """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: (x > 0)::INT) AS b FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
p AS (SELECT q.vec_id AS query_id, c.vec_id,
             list_sum(list_transform(list_zip(q.b, c.b), lambda x: abs(coalesce(x[1], 0) - coalesce(x[2], 0))))::INT AS distance
      FROM c AS q, c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""
