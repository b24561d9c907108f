"""Best-fit packing (operator 5): pattern packing by non-negative least squares.

Documents are tokenised once; pieces of at most 1024 tokens go to a written table without their ids. The histogram of
piece lengths (at most 1024 rows) is all that the driver sees of it. Patterns of one to three lengths that fill a
sequence are enumerated; non-negative least squares fits how often to repeat each so that the histogram is met; counts
are rounded down to what is there, and what remains is packed by best fit, largest first, whole runs at once. Pieces
then find their sequence by their rank among pieces of their length.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, ship, small_batches, table, written

LENGTH = 1024
END_ID = 2
#: Pieces of one length that one task ranks.
RANKED_ROWS = 250_000
PIECE = "doc_id {}, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def load_tokenizer(path: str):
    """text -> ids of the tokenizer file, special tokens' strings in a text included, without adding any.

    A byte-level BPE whose merges are its vocabulary in order is run by tiktoken, about four times as fast, which gives
    the same ids; any other file by tokenizers itself.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model", {})
    plain = (
        model.get("type") == "BPE"
        and pre.get("type") == "ByteLevel"
        and not pre.get("add_prefix_space")
        and pre.get("use_regex", True)
        and not spec.get("normalizer")
        and not any(t.get(k) for t in spec.get("added_tokens", ()) for k in ("lstrip", "rstrip", "single_word"))
    )
    if plain:
        import public_tokenizers
        import tiktoken

        printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        rest = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
        joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        if [model["vocab"][t] for t in joined] == list(range(256, 256 + len(joined))):
            run = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
            everything = set(added)
            return lambda text: run.encode_to_numpy(text, allowed_special=everything)
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    return lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)


def cut(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all are `length` long, but the first may be shorter."""
    first = (n - 1) % length + 1
    return [(0, first)] + [(s, length) for s in range(first, n, length)]


def pieces(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32; other columns are ignored.

    A null text counts as empty, which is one piece: the end id. Null ids stay null. An empty table gives no pieces.
    """
    spark, path = docs.sparkSession, tokenizer or default_tokenizer()
    ship(spark)
    small_batches(spark, 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_tokenizer(path)
        for b in batches:
            rows = []
            for no, text in enumerate(b.column(1).to_pylist()):
                ids = np.append(encode(text or ""), END_ID).astype("<u4")
                for k, (start, n) in enumerate(cut(len(ids), length)):
                    rows.append((no, k, start, n, zlib.crc32(ids[start : start + n].tobytes())))
            no, piece, *rest = np.array(rows, np.int64).reshape(-1, 5).T
            # Ids never leave Arrow: as pandas numbers a null among them would make all of them doubles.
            made = [b.column(0).take(pa.array(no)), pa.array(piece.astype(np.int32)), *map(pa.array, rest)]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, PIECE.format(kind))


def patterns(support: np.ndarray, length: int) -> np.ndarray:
    """(n, 3) lengths, falling, 0 for none, of all one to three supported lengths that fill `length` exactly."""
    have = np.zeros(length + 1, bool)
    have[support] = True
    a, b = np.meshgrid(support, support, indexing="ij")
    c = length - a - b
    three = (a >= b) & (b >= c) & (c >= 0)
    three &= have[np.where(three, c, 0)] | (c == 0)
    made = np.stack([a[three], b[three], c[three]], 1)
    return np.vstack([made, [[length, 0, 0]]]) if have[length] else made


def least_squares(made: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 of the least sum of squares of (lengths used - histogram), by accelerated projected gradient."""

    def used(x: np.ndarray) -> np.ndarray:
        u = np.bincount(made.ravel(), np.repeat(x, made.shape[1]), len(histogram))
        u[0] = 0
        return u

    def back(r: np.ndarray) -> np.ndarray:
        return r[made].sum(1)

    target = histogram.astype(float)
    target[0] = 0
    v = np.ones(len(made))
    for _ in range(30):
        w = back(used(v))
        size = np.linalg.norm(w)
        v = w / size
    x = y = np.zeros(len(made))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(used(y) - target) / (1.05 * size))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of the documents of a sequence, number of such sequences): uses each length as often as it is there."""
    left = np.zeros(length + 1, np.int64)
    for n, count in histogram.items():
        left[n] = count
    runs = []

    def take(lengths: list[int], most: int) -> None:
        need = {n: lengths.count(n) for n in set(lengths)}
        times = min(most, *(int(left[n]) // k for n, k in need.items()))
        if times > 0:
            for n, k in need.items():
                left[n] -= k * times
            runs.append((tuple(lengths), times))

    support = np.flatnonzero(left)
    if len(support):
        made = patterns(support, length)
        if len(made):
            fit = least_squares(made, left)
            for k in np.argsort(-fit, kind="stable"):
                if fit[k] < 0.5:
                    break
                take([int(n) for n in made[k] if n], int(fit[k] + 0.5))
    present = np.flatnonzero(left).tolist()
    while present:
        lengths, room = [present[-1]], length - present[-1]
        while True:
            k = bisect_right(present, room)
            while k and left[present[k - 1]] <= lengths.count(present[k - 1]):
                k -= 1
            if not k:
                break
            lengths.append(present[k - 1])
            room -= present[k - 1]
        take(lengths, 1 << 62)
        present = [n for n in present if left[n]]
    return runs


def _places(runs: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """For each place of each run, sorted by (length, first rank): that key, the first sequence, the offset."""
    rows, rank, sequence = [], {}, 0
    for lengths, times in runs:
        offset = 0
        for n in lengths:
            rows.append((n << 40 | rank.get(n, 0), sequence, offset))
            rank[n] = rank.get(n, 0) + times
            offset += n
        sequence += times
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows, strict=True))


def pack(cut_pieces: DataFrame, length: int = LENGTH, ranked_rows: int = RANKED_ROWS) -> DataFrame:
    """The pieces with sequence_id and offset: each sequence holds at most `length` tokens, without gaps from 0.

    Repeated rows are pieces of their own. An empty table gives an empty result. A common length is ranked in parts, so
    no task takes more than about ranked_rows of it. Other columns stay; those named sequence_id or offset are replaced.
    """
    spark = cut_pieces.sparkSession
    cut_pieces = cut_pieces.drop("sequence_id", "offset")
    part_no, many, rank, found = (fresh(cut_pieces, f"pack_{k}") for k in ("part", "parts", "rank", "place"))
    histogram = {r[0]: r[1] for r in cut_pieces.groupBy("length").count().collect()}  # at most `length` rows
    if not histogram:
        return cut_pieces.selectExpr("*", "0L AS sequence_id", "0L AS offset").where("false")
    keys, sequences, offsets = _places(plan(histogram, length))
    parts = {n: -(-c // ranked_rows) for n, c in histogram.items() if c > ranked_rows}
    dealt = cut_pieces.withColumn(part_no, F.lit(0))
    if parts:
        # At most `length` rows; joined, since a condition for each length would make an expression too deep to plan.
        known = F.broadcast(spark.createDataFrame(list(parts.items()), f"length long, {many} long"))
        number = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.coalesce(many, F.lit(1))).cast("int")
        dealt = cut_pieces.join(known, "length", "left").withColumn(part_no, number)
    base, at = {}, {}
    # At most `length` rows, and one for each ranked_rows pieces.
    for n, part, c in sorted(tuple(r) for r in dealt.groupBy("length", part_no).count().collect()):
        base[n, part] = at.get(n, 0)
        at[n] = base[n, part] + c
    numbered = dealt.selectExpr(
        "*", f"row_number() OVER (PARTITION BY length, {part_no} ORDER BY doc_id, piece, ids_crc32) AS {rank}"
    )
    shared = spark.sparkContext.broadcast((keys, sequences, offsets, base))

    @F.pandas_udf("sequence_id long, offset long")
    def place(n: pd.Series, part: pd.Series, nth: pd.Series) -> pd.DataFrame:
        keys, sequences, offsets, base = shared.value
        first = np.fromiter((base[k] for k in zip(n, part, strict=True)), np.int64, len(n))
        key = n.to_numpy(np.int64) << 40 | (first + nth.to_numpy(np.int64) - 1)
        k = np.searchsorted(keys, key, "right") - 1
        return pd.DataFrame({"sequence_id": sequences[k] + key - keys[k], "offset": offsets[k]})

    placed = numbered.withColumn(found, place("length", part_no, rank))
    return placed.select(*cut_pieces.columns, f"{found}.sequence_id", f"{found}.offset")


def pack_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    return pack(written(pieces(docs, tokenizer), "pieces"))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def pack_all(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A pipeline stage, the last one: the pieces of all documents and where they go."""
    return pack_documents(docs)
