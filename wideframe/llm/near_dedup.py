"""Near-duplicate classes by BagMinHash (operator 7).

Of each distinct text a weighted signature is made over its multiset of five-word shingles. A shingle's weights are
discretised at whole numbers: unit cells [0,1), [1,2), ... of a weight axis. Blocks [0,1), [1,2), [2,4), [4,8), ... are
the roots of a hierarchy of Poisson processes: a block's process has the rate of its length, and its first point goes to
one of the block's halves by the block's seed, while the other half's first point comes later by an interval of its own.
So a process is split, half by half, down to unit cells, whose points carry a register each. Halves that lie above the
weight are dropped, and so is every process whose next point is later than the text's last register has now, which is
what makes it quick. A register holds the first point below the weight, so two registers agree with the probability of
the weighted Jaccard similarity.

Signatures are banded. A bucket of any size is dealt into bounded chunks, differently for each band, and a text meets a
few neighbours of its chunk in signature order, never all others. Pairs whose signatures agree
enough are verified on the exact multisets: first each text's best pair, then, of the other pairs, those that the
components found so far do not join already. What was not met is compared last, in blocks of two bounded chunks: the
signatures of a bucket whose texts candidate pairs do not hold together, then the multisets of each group that candidate
pairs hold together but verified ones do not. Each pair of a group is in one block, so none is left out at any size.
Components are found by star contraction over written edge tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from .common import fresh, ship, small_batches, table, written

WORDS = 5
SIMILARITY = 0.8
#: Registers, and rows of a band: a pair of similarity 0.8 shares no band with probability (1 - 0.8**4)**32 = 5e-8.
REGISTERS = 128
BAND_ROWS = 4
#: Standard deviations of the signature's estimate below the threshold at which a pair is still verified.
MARGIN = 4.0
FLOOR = SIMILARITY - MARGIN * (SIMILARITY * (1 - SIMILARITY) / REGISTERS) ** 0.5
#: Shingles that are hashed at once.
CHUNK = 60_000
#: Texts of one chunk of a bucket or group, and how many of those before it in a bucket each text meets.
CHUNK_TEXTS, NEIGHBOURS = 1000, 3
#: Bytes of multisets of one chunk; a text with more is a chunk of about its own.
CHUNK_BYTES = 8 << 20
#: Edges that one task may join: about 200 bytes each in its table of vertices.
FEW_EDGES = 250_000
#: Keys that a semi join may broadcast (16 bytes each, about 80 in the hash table).
BROADCAST_KEYS = 400_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_HALVES = (np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, hash) of all shingles; a text of one to four words is one shingle, of none has none."""
    words, counts = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        w = t.lower().split()
        counts[i] = len(w)
        words += w
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    codes, distinct = pd.factorize(np.array(words, dtype=object))
    h = pd.util.hash_array(distinct, categorize=False)[codes]
    ends = np.cumsum(counts)
    # Words past a short text's end count as 0; a text of at least five words has no shingle that reaches its end.
    h = np.append(h, np.zeros(WORDS - 1, np.uint64))
    end_of = np.repeat(ends, counts)
    at = np.arange(len(words))
    whole = at + WORDS <= end_of
    first = np.zeros(len(words), bool)
    first[(ends - counts)[counts > 0]] = True
    keep = np.flatnonzero(whole | (first & (np.repeat(counts, counts) < WORDS)))
    out = np.zeros(len(keep), np.uint64)
    for k in range(WORDS):
        w = np.where(keep + k < end_of[keep], h[keep + k], np.uint64(0))
        out = _mix(out * _GOLD + w + np.uint64(k + 1))
    return np.repeat(np.arange(len(texts)), counts)[keep], out


def multisets(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight) of the distinct shingles of each text, sorted."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def _uniform(u: np.ndarray) -> np.ndarray:
    """In (0, 1], of hashes."""
    return ((u >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53


def _split(seed, low, size, t) -> list[tuple[np.ndarray, ...]]:
    """(index, seed, low, size, t) of both halves of each block: the point at t is in one, the other's comes later."""
    half, at = size / 2, np.arange(len(seed))
    u = _mix(seed + _M1)
    right = (u & np.uint64(1)).astype(bool)
    later = t - np.log(_uniform(_mix(u + _GOLD))) / half
    halves = []
    for side in (0, 1):
        own = _mix(u + _HALVES[side])
        halves.append((at, own, low + side * half, half, np.where(right == side, t, later)))
    return halves


def _points(doc, seed, low, size, weight, limit, n_docs, registers) -> np.ndarray:
    """(n_docs, registers) times of the first points below the weight, up to each text's limit; inf where there is none.

    All processes of all texts go one step at a time: blocks are split, cells give a point. A text's limit falls to its
    greatest register as soon as all of them are filled.
    """
    sig = np.full(n_docs * registers, np.inf)
    limit = limit.copy()
    t = -np.log(_uniform(_mix(seed + _GOLD))) / size
    while len(doc):
        go = (t <= limit[doc]) & (low < weight)
        doc, seed, low, size, weight, t = (x[go] for x in (doc, seed, low, size, weight, t))
        cell = size <= 1
        blocks = np.flatnonzero(~cell)
        if len(blocks):
            halves = [np.concatenate(c) for c in zip(*_split(seed[blocks], low[blocks], size[blocks], t[blocks]), strict=True)]
            at = blocks[halves[0]]
            split = (doc[at], halves[1], halves[2], halves[3], weight[at], halves[4])
            doc, seed, low, size, weight, t = (x[cell] for x in (doc, seed, low, size, weight, t))
        u = _mix(seed + _M2)
        register = (u & np.uint64(0xFFFFFF)).astype(np.int64) % registers
        np.minimum.at(sig, doc * registers + register, t)
        seed = u
        t = t - np.log(_uniform(_mix(seed + _GOLD)))
        if len(blocks):
            doc, seed, low, size, weight, t = (
                np.concatenate(p) for p in zip((doc, seed, low, size, weight, t), split, strict=True)
            )
        limit = np.minimum(limit, sig.reshape(n_docs, registers).max(1))
    return sig.reshape(n_docs, registers)


def signatures(doc: np.ndarray, h: np.ndarray, n_docs: int, registers: int = REGISTERS) -> np.ndarray:
    """(n_docs, registers) uint64 register values; rows of texts without shingles are 0."""
    doc, h, weight = multisets(doc, h)
    parts = [(doc, h, np.zeros(len(doc)), np.ones(len(doc)), weight)]
    level = 0
    while True:
        low = float(1 << level)
        more = weight > low
        if not more.any():
            break
        d, s, w = doc[more], h[more], weight[more]
        parts.append((d, _mix(s + np.uint64(level + 1)), np.full(len(d), low), np.full(len(d), low), w))
        level += 1
    doc_p, *rest = (np.concatenate(c) for c in zip(*parts, strict=True))
    total = np.bincount(doc, weight, n_docs)
    has = total > 0
    # By this time all registers are filled in all but about 2 of 100 texts; the limit falls as soon as they are.
    limit = np.where(has, registers * (np.log(registers) + 4) / np.maximum(total, 1), 0)
    sig = _points(doc_p, *rest, limit, n_docs, registers)
    while True:  # the few texts with an empty register, once more over twice the time
        short = np.flatnonzero(has & np.isinf(sig).any(1))
        if not len(short):
            break
        limit[short] *= 2
        again = np.isin(doc_p, short)
        renumber = np.searchsorted(short, doc_p[again])
        sig[short] = _points(renumber, *(x[again] for x in rest), limit[short], len(short), registers)
    sig[~has] = 0
    return _mix(sig.view(np.uint64))


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(n_docs, bands) hashes of the bands, different for each band's number."""
    n = sig.shape[1] // BAND_ROWS
    rows = sig[:, : n * BAND_ROWS].reshape(len(sig), n, BAND_ROWS)
    out = np.broadcast_to(np.arange(1, n + 1, dtype=np.uint64) * _GOLD, rows.shape[:2]).copy()
    for k in range(BAND_ROWS):
        out = _mix(out + rows[:, :, k])
    return out.view(np.int64)


def _in_chunks(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Slices of about CHUNK shingles by the texts' lengths; a text that is longer is a slice of its own."""
    size = np.cumsum(pdf["text"].str.len().to_numpy() // 6 + 1)
    for _, part in pdf.groupby(size // CHUNK, sort=False):
        yield part


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: set[bytes] = set()  # of this task: copies need no second signature
    for pdf in batches:
        pdf["key"] = [bytes(k) for k in pdf["key"]]
        pdf = pdf[~pdf["key"].isin(seen)].drop_duplicates("key")
        seen.update(pdf["key"])
        for part in _in_chunks(pdf):
            doc, h = shingles(part["text"].tolist())
            has = np.unique(doc)
            if not len(has):
                continue
            sig = signatures(np.searchsorted(has, doc), h, len(has))
            small = (sig >> np.uint64(56)).astype(np.uint8)
            keys = part["key"].to_numpy()[has]
            yield pd.DataFrame({"key": keys, "sig": [x.tobytes() for x in small], "bands": list(band_keys(sig))})


def _multiset_blobs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for part in _in_chunks(pdf):
            doc, h = shingles(part["text"].tolist())
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
            at = np.flatnonzero(new)
            nth = np.arange(len(h)) - np.repeat(at, np.diff(np.append(at, len(h))))
            h = np.where(nth > 0, _mix(h + nth.astype(np.uint64) * _GOLD), h)
            ends = np.searchsorted(doc, np.arange(len(part)), "right")
            starts = np.append(0, ends[:-1])
            blobs = [np.sort(h[a:b]).tobytes() for a, b in zip(starts, ends, strict=True)]
            yield pd.DataFrame({"id": part["id"].to_numpy(), "blob": blobs})


def _once(function: Callable) -> Callable:
    """A column function that a filter on its result does not run again: a second Python process for each task otherwise."""
    return F.pandas_udf(function, DoubleType()).asNondeterministic()


@_once
def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of equal registers; each is one byte, so chance agreement of 1/256 is taken off."""
    x = np.frombuffer(b"".join(a), np.uint8).reshape(len(a), -1)
    y = np.frombuffer(b"".join(b), np.uint8).reshape(len(b), -1)
    return pd.Series(((x == y).mean(1) - 1 / 256) / (1 - 1 / 256))


@_once
def overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    """Exact weighted Jaccard similarity of two multisets, each given as sorted hashes of (shingle, nth copy)."""
    out = np.zeros(len(a))
    for k, (p, q) in enumerate(zip(a, b, strict=True)):
        x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
        if len(x) > len(y):
            x, y = y, x
        at = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
        both = int((y[at] == x).sum()) if len(x) else 0
        out[k] = both / max(1, len(x) + len(y) - both)
    return pd.Series(out)


def _union_find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = root[x]
        return x

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    found = [(v, find(v)) for v in list(root)]
    yield pd.DataFrame([x for x in found if x[0] != x[1]], columns=["v", "root"], dtype="int64")


def _known(found: DataFrame) -> DataFrame:
    """To be broadcast in a join if it is small; else the join is by its keys, and AQE splits what is skewed."""
    return F.broadcast(found) if found.count() <= BROADCAST_KEYS else found


def components(edges: DataFrame, name: str = "components", few: int = FEW_EDGES) -> DataFrame:
    """(v, root) of every vertex with an edge in edges (a, b): root is the least vertex of its component.

    Up to `few` edges fit one task, which joins them at once; more are contracted to stars over all tasks.
    """
    e = written(edges.selectExpr("greatest(a, b) AS a", "least(a, b) AS b").where("a <> b").distinct(), name)
    if e.count() <= few:
        return written(e.coalesce(1).mapInPandas(_union_find, "v long, root long"), name)
    before = None
    while True:
        both = e.union(e.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large star: neighbours greater than u get the least of u's neighbourhood.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # Small star, over edges from a to smaller b: all of them, and a, get the least b.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("x"), "m").union(low.select("a", "m"))
        e = written(small.toDF("a", "b").where("a <> b").distinct(), name)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return e.toDF("v", "root")
        before = now


def candidate_pairs(signed: DataFrame) -> DataFrame:
    """(x, y, est): pairs of texts of one bucket whose signatures agree, y < x; linear in the buckets' rows.

    A bucket is dealt at random into chunks of about CHUNK_TEXTS, differently for each band. In a chunk, texts are
    sorted by the registers that follow the band's, so that neighbours agree in more than the band; each text meets
    the NEIGHBOURS before it and the chunk's first text.
    """
    bands = signed.select("id", F.posexplode("bands").alias("b", "band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    met = bands.join(shared, "band").join(signed.select("id", "sig"), "id")
    chunk = F.pmod(F.xxhash64("id", "band"), F.ceil(F.col("n") / CHUNK_TEXTS))
    after = F.substring(F.concat("sig", "sig"), F.lit(BAND_ROWS) * (F.col("b") + 1) + 1, F.lit(16))
    rows = met.select("id", "sig", "band", chunk.alias("chunk"), after.alias("after"))
    w = Window.partitionBy("band", "chunk").orderBy("after", "id")
    me = F.struct("id", "sig")
    others = [F.lag(me, k).over(w) for k in range(1, NEIGHBOURS + 1)] + [F.first(me).over(w)]
    rows = rows.select("id", "sig", F.array(*others).alias("others"))
    pairs = rows.select("id", "sig", F.explode(F.array_distinct("others")).alias("o")).where("o.id <> id")
    scored = pairs.select("id", F.col("o.id").alias("other"), agreement("sig", "o.sig").alias("est"))
    fits = scored.where(F.col("est") >= FLOOR)
    return fits.groupBy(F.greatest("id", "other").alias("x"), F.least("id", "other").alias("y")).agg(
        F.max("est").alias("est")
    )


BLOCK = ["own_i", "part_i", "own_j", "part_j"]


def blocks(rows: DataFrame, key: str, cls: str, weight: Column) -> DataFrame:
    """rows (id, key, cls, ...), once for each block that they are compared in, with `right` and the block's columns BLOCK.

    A group, all rows of one key, is dealt into chunks of about CHUNK_TEXTS rows and CHUNK_BYTES of weight. A block is
    two chunks of a group, or one, so every pair of rows is in just one. A class of more rows than a chunk has chunks of
    its own, of which no two meet: their rows are linked already.
    """
    sizes = rows.groupBy(key, cls).agg(F.count("*").alias("n"), F.sum(weight).alias("weight"))
    sizes = sizes.withColumn("own", F.when(F.col("n") > CHUNK_TEXTS, F.col(cls)).otherwise(-1))
    parts = F.greatest(F.ceil(F.sum("n") / CHUNK_TEXTS), F.ceil(F.sum("weight") / CHUNK_BYTES), F.lit(1))
    dealt = written(sizes.groupBy(key, "own").agg(parts.alias("parts")), "dedup-chunks")
    # Both tables have a row for a thousand rows or so at most, and are broadcast where they are small.
    alone = _known(dealt.where("own >= 0").select(key, F.col("own").alias(cls), F.lit(True).alias("alone")))
    many = _known(dealt.where("parts > 1"))
    rows = rows.join(alone, [key, cls], "left").withColumn("own", F.expr(f"if(alone, {cls}, -1)")).drop("alone")
    rows = rows.join(many, [key, "own"], "left")
    part = F.pmod(F.xxhash64("id", F.lit(17)), F.coalesce("parts", F.lit(1))).cast("int")
    rows = rows.withColumn("part", part).drop("parts")
    chunks = dealt.select(key, "own", F.explode(F.expr("sequence(0, cast(parts AS int) - 1)")).alias("part"))
    pairs = chunks.toDF(key, "own_i", "part_i").join(chunks.toDF(key, "own_j", "part_j"), key)
    pairs = pairs.where("(own_i < own_j OR own_i = own_j AND part_i <= part_j) AND NOT (own_i >= 0 AND own_i = own_j)")
    one = pairs.selectExpr(key, *BLOCK, "false AS right", "own_i AS own", "part_i AS part")
    two = pairs.where("own_i <> own_j OR part_i <> part_j")
    sides = one.union(two.selectExpr(key, *BLOCK, "true AS right", "own_j AS own", "part_j AS part"))
    return rows.join(sides, [key, "own", "part"])


def _sides(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    right = pdf["right"].to_numpy()
    left = np.flatnonzero(~right)
    return left, np.flatnonzero(right) if right.any() else left


def _links(pdf: pd.DataFrame, cls: str, left: np.ndarray, right: np.ndarray, fits) -> pd.DataFrame:
    """(a, b): of the pairs that fit, as many as join all classes that they hold together; fits(k) is left row k's mask."""
    ids, root = pdf["id"].to_numpy(), pd.factorize(pdf[cls])[0]
    out = []
    for k, row in enumerate(left):
        hit = right[fits(k)]
        hit = hit[root[hit] != root[row]]
        for r, at in zip(*np.unique(root[hit], return_index=True), strict=True):
            out.append((max(ids[row], ids[hit[at]]), min(ids[row], ids[hit[at]])))
            root[root == r] = root[row]
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _alike(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of a block by signatures."""
    sig = np.frombuffer(b"".join(bytes(b) for b in pdf["sig"]), np.uint8).reshape(len(pdf), -1)
    left, right = _sides(pdf)
    y = sig[right]
    fits = lambda k: ((y == sig[left[k]]).mean(1) - 1 / 256) / (1 - 1 / 256) >= FLOOR
    return _links(pdf, "loose", left, right, fits)


def common_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """(len(x), len(y)) sizes of the intersections of sets of hashes."""
    hx, hy = np.concatenate(x), np.concatenate(y)
    rx, ry = (np.repeat(np.arange(len(s)), [len(v) for v in s]) for s in (x, y))
    both = np.intersect1d(hx, hy)
    out = np.zeros((len(x), len(y)), np.float32)
    if not len(both):
        return out
    columns = []
    for h, r in ((hx, rx), (hy, ry)):
        at = np.minimum(np.searchsorted(both, h), len(both) - 1)
        keep = np.flatnonzero(both[at] == h)
        keep = keep[np.argsort(at[keep], kind="stable")]
        columns.append((at[keep], r[keep]))
    (cx, rx), (cy, ry) = columns
    times = np.bincount(cy, minlength=len(both))
    first = np.cumsum(times) - times
    few = times[cx] <= 4  # rare hashes pair by pair, the others as products of matrices
    own = times[cx[few]]
    where = np.repeat(first[cx[few]] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
    np.add.at(out.reshape(-1), np.repeat(rx[few], own) * len(y) + ry[where], 1)
    often = np.flatnonzero(times > 4)
    number = np.full(len(both), -1)
    number[often] = np.arange(len(often))
    nx, ny = number[cx], number[cy]
    rx, nx, ry, ny = rx[nx >= 0], nx[nx >= 0], ry[ny >= 0], ny[ny >= 0]
    for c in range(0, len(often), 512):
        (xa, xb), (ya, yb) = (np.searchsorted(n, [c, c + 512]) for n in (nx, ny))
        p, q = np.zeros((len(x), 512), np.float32), np.zeros((len(y), 512), np.float32)
        p[rx[xa:xb], nx[xa:xb] - c] = 1
        q[ry[ya:yb], ny[ya:yb] - c] = 1
        out += p @ q.T
    return out


def _overlapping(similarity: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links of a block by exact weighted Jaccard similarity."""
        sets = [np.frombuffer(bytes(b), np.uint64) for b in pdf["blob"]]
        size = np.array([len(s) for s in sets])
        left, right = _sides(pdf)
        common = common_counts([sets[k] for k in left], [sets[k] for k in right]).astype(np.float64)
        fits = lambda k: common[k] / np.maximum(1, size[left[k]] + size[right] - common[k]) >= similarity
        return _links(pdf, "strict", left, right, fits)

    return run


def loose_groups(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """(id, loose): the groups that all pairs of one bucket whose signatures agree hold together, met in `pairs` or not."""
    edges = pairs.selectExpr("x AS a", "y AS b")
    loose = components(edges, "dedup-loose")
    loose = loose.union(loose.select("root", "root").distinct()).toDF("id", "loose")
    # A bucket of up to NEIGHBOURS + 2 texts is met wholly by `candidate_pairs`.
    bands = signed.select("id", F.explode("bands").alias("band"))
    crowded = bands.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > NEIGHBOURS + 2)
    rows = bands.join(crowded, "band", "left_semi").join(loose, "id", "left")
    rows = written(rows.select("id", "band", F.coalesce("loose", "id").alias("loose")), "dedup-crowded")
    apart = rows.groupBy("band").agg(F.min("loose").alias("s"), F.max("loose").alias("t")).where("s <> t")
    rows = written(rows.join(apart.select("band"), "band", "left_semi"), "dedup-apart-buckets")
    if rows.isEmpty():
        return loose
    met = blocks(rows, "band", "loose", F.lit(REGISTERS)).join(signed.select("id", "sig"), "id")
    more = written(met.groupBy("band", *BLOCK).applyInPandas(_alike, "a long, b long"), "dedup-alike")
    loose = components(edges.union(more), "dedup-loose")
    return loose.union(loose.select("root", "root").distinct()).toDF("id", "loose")


def unlinked(loose: DataFrame, linked: DataFrame, named: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b): verified links that join the classes (v, root) of each group (id, loose), found among all its pairs."""
    rows = loose.join(linked.toDF("id", "strict"), "id", "left").withColumn("strict", F.coalesce("strict", "id"))
    rows = written(rows.select("id", "loose", "strict"), "dedup-groups")
    groups = rows.groupBy("loose").agg(F.min("strict").alias("s"), F.max("strict").alias("t")).where("s <> t")
    rows = written(rows.join(groups.select("loose"), "loose", "left_semi"), "dedup-open")
    blobs = multisets_of(rows.select("id"), named, texts, "dedup-third")
    sized = written(rows.join(blobs.select("id", F.length("blob").alias("bytes")), "id"), "dedup-sized")
    met = blocks(sized, "loose", "strict", F.col("bytes")).join(blobs, "id")
    return written(met.groupBy("loose", *BLOCK).applyInPandas(_overlapping(similarity), "a long, b long"), "dedup-third")


def multisets_of(ids: DataFrame, named: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """(id, blob) of these texts, written."""
    wanted = named.join(ids.distinct(), "id", "left_semi")
    wanted = written(wanted.selectExpr("id", "key AS k", "least_id"), f"{name}-wanted")
    # One row of each text: that of its least doc_id.
    met = texts.join(_known(wanted), F.expr("key = k AND doc_id <=> least_id")).select("id", "text")
    made = met.mapInPandas(_multiset_blobs, "id long, blob binary").dropDuplicates(["id"])
    return written(made, f"{name}-multisets")


def verified(pairs: DataFrame, named: DataFrame, texts: DataFrame, similarity: float, name: str) -> DataFrame:
    """The pairs (x, y) whose texts' multisets overlap enough, as written edges (a, b, similarity)."""
    blobs = multisets_of(pairs.selectExpr("explode(array(x, y)) AS id"), named, texts, name)
    joined = pairs.select("x", "y").join(blobs.toDF("x", "bx"), "x").join(blobs.toDF("y", "by"), "y")
    scored = joined.select(F.col("x").alias("a"), F.col("y").alias("b"), overlap("bx", "by").alias("similarity"))
    return written(scored.where(F.col("similarity") >= similarity), f"{name}-edges")


def text_key() -> Column:
    return F.unhex(F.md5(F.col("text").cast("binary")))


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(key, class_id, copies, links, head, repeats) of the texts that are not alone in their class, written.

    key: the text's hash. class_id: the least doc_id of the class (null if it has null ones only). head: whether the
    class keeps a row of this text, which is true of one of its texts: of those with a row of class_id, the least by
    key. repeats: the rows of this text with its least doc_id.
    """
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark, 500)
    all_texts = docs.select(text_key().alias("key"), "text", "doc_id").where("key IS NOT NULL")
    rows = all_texts.groupBy("key", "doc_id").agg(F.count("*").alias("n"))
    members = rows.groupBy("key").agg(
        F.min("doc_id").alias("least_id"),
        F.sum("n").alias("copies"),
        F.coalesce(F.min_by("n", "doc_id"), F.sum("n")).alias("repeats"),
    )
    members = written(members, "dedup-texts")
    kind = "key binary, sig binary, bands array<long>"
    signed = all_texts.select("key", "text").mapInPandas(_sign, kind).dropDuplicates(["key"])
    # Each distinct text gets a number, kept in the written table; from here on texts are longs.
    signed = written(signed.withColumn("id", F.monotonically_increasing_id()), "dedup-signatures")
    named = written(signed.select("id", "key").join(members.select("key", "least_id"), "key"), "dedup-named")
    pairs = written(candidate_pairs(signed), "dedup-pairs")
    best = pairs.withColumn("nth", F.expr("row_number() OVER (PARTITION BY x ORDER BY est DESC, y)")).where("nth = 1")
    best = written(best.select("x", "y"), "dedup-best")
    first = verified(best, named, all_texts, similarity, "dedup-first")
    root = components(first.select("a", "b")).toDF("v", "root")
    apart = (
        pairs.join(root.toDF("x", "rx"), "x", "left")
        .join(root.toDF("y", "ry"), "y", "left")
        .where("coalesce(rx, x) <> coalesce(ry, y)")
        .join(best, ["x", "y"], "left_anti")
    )
    apart = written(apart.select("x", "y"), "dedup-apart")
    second = verified(apart, named, all_texts, similarity, "dedup-second")
    root = components(first.union(second).select("a", "b"))
    root = root.union(root.select("root", "root").distinct())
    third = unlinked(loose_groups(pairs, signed), root, named, all_texts, similarity)
    edges = written(first.union(second).select("a", "b").union(third), "dedup-links")
    root = components(edges)
    roots = root.union(root.select("root", "root").distinct()).toDF("id", "root")
    links = edges.selectExpr("explode(array(a, b)) AS id").groupBy("id").agg(F.count("*").alias("links"))
    linked = named.join(roots, "id").join(links, "id")
    first_of = F.min(F.struct(F.col("least_id").isNull(), "least_id", "key"))
    heads = linked.groupBy("root").agg(first_of.alias("first"))
    linked = linked.join(heads, "root").select(
        "key", "links", F.col("first.least_id").alias("class_least"), (F.col("key") == F.col("first.key")).alias("own")
    )
    lone = F.col("links").isNull()
    return written(
        members.join(linked, "key", "left")
        .where("copies > 1 OR links IS NOT NULL")
        .select(
            "key",
            F.when(lone, F.col("least_id")).otherwise(F.col("class_least")).alias("class_id"),
            "copies",
            F.coalesce("links", F.lit(0)).cast("long").alias("links"),
            F.coalesce("own", F.lit(True)).alias("head"),
            "repeats",
        ),
        "dedup-classes",
    )


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, copies, links for each row: class_id is the least doc_id of its class of near-duplicates.

    Words are the lower-cased texts' runs without white space. Equal texts are one class, empty ones too; a null text
    is a class of its own row, and so is any text without a link. links counts the verified links that the text has in
    the spanning set (0 for a class of equal texts only). Repeated rows share a class; other columns are ignored. An
    empty table gives an empty result.
    """
    found = _known(classes(docs, similarity).select("key", "class_id", "copies", "links"))
    keyed = docs.select("doc_id", text_key().alias("key"))
    return keyed.join(found, "key", "left").select(
        "doc_id",
        F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("copies", F.lit(1)).alias("copies"),
        F.coalesce("links", F.lit(0)).cast("long").alias("links"),
    )


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A pipeline stage: of each class one row stays, with the class's least doc_id.

    Rows go by their doc_id and text, so another text under the same doc_id stays. Null texts all stay. Where all ids of
    a class are null, or a row is repeated, one of the rows stays. An empty table gives an empty result.
    """
    found = classes(docs)
    key, head, least, repeats = (fresh(docs, f"dedup_{n}") for n in ("key", "head", "least", "repeats"))
    marked = docs.withColumn(key, text_key()).join(
        _known(found.select(F.col("key").alias(key), F.col("head").alias(head), F.col("class_id").alias(least), F.col("repeats").alias(repeats))),
        key,
        "left",
    )
    stays = F.col(head).isNull() | (F.col(head) & F.col("doc_id").eqNullSafe(F.col(least)))
    kept = marked.where(stays)
    if found.where("head AND repeats > 1").isEmpty():
        return kept.select(*docs.columns)
    again = F.coalesce(F.col(repeats) > 1, F.lit(False))
    once = kept.where(again).dropDuplicates([key])
    return kept.where(~again).union(once).select(*docs.columns)
