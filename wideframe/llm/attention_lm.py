"""Language-model scoring (operator 4): a causal self-attention model in numpy, over subword ids.

A text is its words, lower-cased in A-Z, then one end; a word is the subword ids of " " + word, by a public tokenizer.
The probability of an id is that of its class times the id's share of its class. Frequent ids are classes of their own,
other ids fall into clusters. Attention over the ids before it gives the class: each earlier id's value is a
distribution over classes (one table for the id just before, one for those further back), and the attention weights,
from queries, keys and distances, mix them, with one weight for the plain class frequencies. A mixture of distributions
needs no normalising sum over the classes, so only the target's column of the tables is read.

Windows of CONTEXT + SCORED ids overlap by CONTEXT; each scores its last SCORED ids, so each id is scored once, by
batched masked attention: it sees the last id and the CONTEXT before that. Before a text stand end ids. A word's probability is then mixed with its share of all training
words, by the weight OF_IDS: attention knows how words are built and what stands around them, counts know rare words.

Texts are encoded once, in blocks of bounded size that number their own words. A block's words meet all others' for the
counts, and come back as an array by number, so scoring needs no word and no dictionary again. Word counts, id counts,
what stands around each id (for the clusters) and the value tables are taken over all training documents, as sums of
arrays. Attention weights are fitted by each task on all windows of its texts, and averaged
over the tasks.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property, lru_cache
from itertools import chain, count, islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ship, small_batches, table, written
from .lang_id import remainder

CONTEXT, SCORED, WIDTH = 32, 16, 16
OWN_CLASSES, CLUSTERS, OWN_INPUTS = 1984, 64, 1024
CLASSES, INPUTS = OWN_CLASSES + CLUSTERS, OWN_INPUTS + CLUSTERS
#: Windows that are scored, or whose slopes are found, at once.
BATCH = 512
#: Windows of a task's first step of the descent, and of its largest; each step has an eighth more than the one before.
STEP, MOST_STEP = 64, 4096
#: Documents whose words are looked up at once.
DOCS = 500
#: Windows that a task holds before it descends on them.
FIT_HELD = 16_384
#: Frequent ids whose places around other ids are told apart for the clusters, and places an id needs for a cluster.
AROUND, LEAST_AROUND = 256, 12
#: Ids whose pairs are counted at once, and in one table of 32-bit counts.
COUNTED, MOST_COUNTED = 1_000_000, 1 << 28
#: Distances at which pairs are counted for the table of ids further back.
FAR = (2, 3, 6, 12)
#: Where a block of texts ends: at so many different words, or bytes of text.
BLOCK_WORDS, BLOCK_BYTES = 400_000, 48 << 20
#: Bits of a word's number in its key, and of a block's number among those of its task.
NUMBER_BITS, GENERATION_BITS = 28, 12
#: Weight of the attention model in a word's probability; the rest is that of its share of the training words.
OF_IDS = 0.6
END_WORD = b""


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def merged(ranks: dict[bytes, int], piece: bytes) -> list[int]:
    """The ids of a piece: the pair of least rank merges first, the leftmost of equals."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[k : k + 1] for k in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, 1 << 30), k) for k, (a, b) in enumerate(pairwise(parts)))
        if rank == 1 << 30:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _library(path: str, pattern: str):
    """(the tokenizer library's encoding by the ranks of a file, its pieces cut by pattern; the ranks)."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), ranks


@lru_cache(maxsize=2)
def subwords(path: str):
    """(word -> its ids as uint16 bytes, number of ids; the last one is the end)."""
    import public_tokenizers

    run, ranks = _library(path, public_tokenizers.PATTERN)
    size = max(ranks.values()) + 2
    assert size <= 1 << 16
    # A word is one piece: no pattern is run over it. The library has a name for that only inside; else it is done here.
    piece = getattr(getattr(run, "_core_bpe", None), "encode_single_piece", None)
    return lambda w: array("H", piece(b" " + w) if piece else merged(ranks, b" " + w)).tobytes(), size


@lru_cache(maxsize=2)
def many_subwords(path: str):
    """words -> (their ids, laid end to end; the number of ids of each), as `subwords` has them, in one call.

    Words have no space inside, so a piece is a space and what follows up to the next, and an id that begins with a space
    begins a word.
    """
    run, ranks = _library(path, " [^ ]++")  # takes nothing back, so the same pieces as " [^ ]+", found sooner
    begins = np.zeros(max(ranks.values()) + 1, bool)
    begins[[n for piece, n in ranks.items() if piece.startswith(b" ")]] = True

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        try:
            text = b" ".join([b"", *words]).decode()
        except UnicodeDecodeError:  # a lone surrogate: the library takes such words as bytes only
            each = list(map(subwords(path)[0], words))
            return np.frombuffer(b"".join(each), np.uint16), np.array(list(map(len, each))) // 2
        ids = run.encode_to_numpy(text, disallowed_special=())
        return ids.astype(np.uint16), np.diff(np.flatnonzero(begins[ids]), append=len(ids))

    return encode


def words_of(text: str | None) -> list[bytes]:
    """bytes.lower changes A-Z alone, and bytes.split cuts at the six ASCII white space characters alone."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts, as `words_of` has them, laid end to end; the number of words of each text)."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    ends = np.cumsum(pc.list_value_length(parts).fill_null(0).to_numpy())
    flat = parts.flatten()
    full = pc.greater(pc.binary_length(flat), 0)  # white space at a text's start or end leaves an empty part there
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return flat.filter(full), np.diff(before[ends], prepend=0)


# --- the model -----------------------------------------------------------------------------------------------------


@dataclass
class Weights:
    query: np.ndarray  # (inputs, width)
    key: np.ndarray
    offset: np.ndarray  # (CONTEXT + 2,): by distance; the last one is for the plain frequencies


def first_weights() -> Weights:
    rng = np.random.default_rng(3)
    w = Weights(*[rng.normal(0, 0.1, (INPUTS, WIDTH)).astype(np.float32) for _ in range(2)], np.zeros(CONTEXT + 2, np.float32))
    w.offset[:-1] = -2 - np.minimum(np.arange(CONTEXT + 1), 16) / 8
    w.offset[0] = 2
    return w


@dataclass
class Model:
    weights: Weights
    input_of: np.ndarray  # by id
    class_of: np.ndarray
    log_share: np.ndarray  # natural log of the id's share of its class
    near: np.ndarray  # (inputs, classes): probabilities after the id just before
    far: np.ndarray
    plain: np.ndarray  # (classes,)

    @cached_property
    def far_by_class(self) -> np.ndarray:  # (classes, inputs): `far`, a class's values side by side
        return np.ascontiguousarray(self.far.T)


def pulls(w: Weights) -> tuple[np.ndarray, np.ndarray]:
    """(exp of query times key by the two inputs, exp of the offsets): attention weights before they are divided by their sum."""
    return _by_inputs(w.query, w.key), np.exp(np.clip(w.offset, -30, 30))


def _by_inputs(query: np.ndarray, key: np.ndarray) -> np.ndarray:
    out = query @ key.T
    np.clip(out, -30, 30, out=out)
    return np.exp(out, out=out)


@lru_cache(maxsize=16)
def _room(use: str, size: int, kind: type) -> np.ndarray:
    """An array that a process keeps for one use: the pages of a fresh one cost more than what is done with them."""
    return np.zeros(size, kind)


def _at(table_: np.ndarray, places: np.ndarray) -> np.ndarray:
    """What a float32 table holds at int32 places of its flat form, all of them inside: numpy would widen the places."""
    held = pa.Array.from_buffers(pa.float32(), table_.size, [None, pa.py_buffer(table_)])
    at = pa.Array.from_buffers(pa.int32(), places.size, [None, pa.py_buffer(places)])
    return pc.take(held, at, boundscheck=False).to_numpy().reshape(places.shape)


def met(m: Model, by_inputs: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[tuple]:
    """BATCH by BATCH of windows: (which; places in `by_inputs`, what it has there, values), for inputs x (CONTEXT + SCORED, n)
    and classes y (SCORED, n). A row is a target, its columns are what it sees, the nearest id last.

    What the mask hides costs nothing. A target looks up one row of each table, which stays in the cache meanwhile. The
    next batch uses the same arrays, of small numbers, since all tasks of a machine share its cache. Values may be
    written to, what `by_inputs` has may not.
    """
    x, y, columns = np.ascontiguousarray(x.T, np.int32), np.ascontiguousarray(y.T, np.int32), CONTEXT + 1
    seen = sliding_window_view(x, columns, axis=1)
    own = x[:, CONTEXT:]
    nearest = m.near.ravel().take(own * CLASSES + y)
    of_class, of_input = ((a * INPUTS)[:, :, None] for a in (y, own))
    size = BATCH * SCORED * columns
    places, value = _room("places", size, np.int32), _room("value", size, np.float32)
    for at in range(0, len(y), BATCH):
        part = slice(at, at + BATCH)
        shape = seen[part].shape
        p, v = (held[: seen[part].size].reshape(shape) for held in (places, value))
        np.add(of_class[part], seen[part], out=p)
        v[...] = _at(m.far_by_class, p)
        v[:, :, -1] = nearest[part]
        np.add(of_input[part], seen[part], out=p)
        yield part, p.reshape(-1, columns), _at(by_inputs, p).reshape(-1, columns), v.reshape(-1, columns)


def log_class(m: Model, pull: tuple[np.ndarray, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(SCORED, n) natural log probabilities of classes y after inputs x (CONTEXT + SCORED, n)."""
    by_inputs, by_distance = pull
    distance, plain = np.ascontiguousarray(by_distance[CONTEXT::-1]), by_distance[-1]
    out = np.empty(y.T.shape, np.float32)
    for part, _, a, v in met(m, by_inputs, x, y):
        v *= a
        total = v @ distance + plain * m.plain[y.T[part]].ravel()
        out[part] = np.log(total / (a @ distance + plain)).reshape(-1, SCORED)
    return out.T


def slopes(m: Model, x: np.ndarray, y: np.ndarray, use: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean loss by query, key and offset, over classes y (SCORED, n) after inputs x (CONTEXT + SCORED, n).

    A score's slope is added to its pair of inputs; products with all keys and queries are taken once, of the sums. Both
    tables of pairs are kept from step to step, and only rows of inputs that ask here are made anew: others aren't met.
    """
    w = m.weights
    asks = np.flatnonzero(np.bincount(x[CONTEXT:].ravel(), minlength=INPUTS))
    query, by_distance = w.query[asks], np.exp(np.clip(w.offset, -30, 30))
    by_inputs, pairs = (_room(use_, INPUTS * INPUTS, np.float32) for use_ in ("by inputs", "pairs"))
    by_inputs.reshape(INPUTS, INPUTS)[asks] = _by_inputs(query, w.key)
    pairs.reshape(INPUTS, INPUTS)[asks] = 0
    pull = _room("pull", BATCH * SCORED * (CONTEXT + 1), np.float32)
    distance, plain = np.ascontiguousarray(by_distance[CONTEXT::-1]), by_distance[-1]
    offset, of_mean = np.zeros(CONTEXT + 2), np.float32(1 / max(1, use.sum()))
    all_seen = np.ones(CONTEXT + 1, np.float32)
    for part, p, a, v in met(m, by_inputs, x, y):
        share, of_plain = (use.T[part] * of_mean).ravel(), plain * m.plain[y.T[part]].ravel()
        a = np.multiply(a, distance, out=pull[: a.size].reshape(a.shape))
        v *= a
        weight, total = share / (a @ all_seen + plain), share / (v @ all_seen + of_plain)
        a *= weight[:, None]  # the weight that a place has, less the share of the probability that it gives
        v *= total[:, None]
        a -= v
        offset[CONTEXT::-1] += np.ones(len(a), np.float32) @ a
        offset[-1] += (plain * weight - of_plain * total).sum()
        np.add.at(pairs, p.ravel(), a.ravel())
    pairs, of_query = pairs.reshape(INPUTS, INPUTS)[asks], np.zeros_like(w.query)
    of_query[asks] = pairs @ w.key
    return [of_query, pairs.T @ query, offset.astype(np.float32)]


def descend(m: Model, sums: list[np.ndarray], x: np.ndarray, y: np.ndarray, use: np.ndarray, step: int = STEP, rate: float = 0.1) -> int:
    """Adagrad on the attention weights, in place, once over the windows x (n, window) in an order fixed by a seed.

    `sums` holds the squared gradients so far, for query, key and offset. The next step's windows are returned.
    """
    w = m.weights
    order = np.random.default_rng(7).permutation(len(x))
    at = 0
    while at < len(x):
        part = order[at : at + step]
        at, step = at + step, min(step + step // 8, MOST_STEP)
        for p, gp, s in zip((w.query, w.key, w.offset), slopes(m, x[part].T, y[part].T, use[part].T), sums, strict=True):
            s += gp * gp
            p -= rate * gp / np.sqrt(s)
    return step


def no_sums(w: Weights) -> list[np.ndarray]:
    return [np.full_like(p, 1e-8) for p in (w.query, w.key, w.offset)]


def windows(ids: list[np.ndarray], end: int) -> tuple[np.ndarray, ...]:
    """(ids that are seen (window, n), target ids (SCORED, n), in use, windows by text) of texts' ids, each with its end."""
    many = np.array([-(-len(i) // SCORED) for i in ids])
    sizes = CONTEXT + many * SCORED
    at = np.cumsum(sizes) - sizes
    flat = np.full(sizes.sum(), end, np.uint16)
    target, use = np.full(sizes.sum(), end, np.uint16), np.zeros(sizes.sum(), bool)
    for i, a in zip(ids, at, strict=True):
        flat[a + CONTEXT + 1 : a + CONTEXT + len(i)] = i[:-1]
        target[a + CONTEXT : a + CONTEXT + len(i)] = i
        use[a + CONTEXT : a + CONTEXT + len(i)] = True
    first = np.repeat(at, many) + SCORED * (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
    seen = sliding_window_view(flat, CONTEXT + SCORED)[first]  # whole rows at once
    target, use = (sliding_window_view(a, SCORED)[first + CONTEXT] for a in (target, use))
    return seen.T, target.T, use.T, many


def around_counts(ids: list[np.ndarray], number: np.ndarray, needed: np.ndarray, around: np.ndarray) -> None:
    """Adds, in place, how often each frequent id (by number) stands just before and after each needed id, to `around` (flat)."""
    n = int(number.max()) + 1
    flat = np.concatenate(ids)
    inside = np.ones(len(flat), bool)  # an id with another one before it in its text
    inside[np.cumsum([0, *[len(i) for i in ids[:-1]]])] = False
    want = needed[flat]
    at = np.flatnonzero(inside & want)
    np.add.at(around, flat[at].astype(np.int64) * 2 * n + number[flat[at - 1]], 1)
    at = np.flatnonzero(inside[1:] & want[:-1]) + 1
    np.add.at(around, flat[at - 1].astype(np.int64) * 2 * n + n + number[flat[at]], 1)


def _numbers(order: np.ndarray) -> np.ndarray:
    """By id: its place among the AROUND most frequent ids, or AROUND for all others."""
    number = np.full(len(order), min(AROUND, len(order)), np.int64)
    number[order[:AROUND]] = np.arange(min(AROUND, len(order)))
    return number


def _clusters(around: np.ndarray) -> np.ndarray:
    """A cluster (0 to CLUSTERS - 1) for each id: spherical k-means over which frequent ids stand before and after it."""
    seen = np.flatnonzero(around.sum(1) >= LEAST_AROUND)
    cluster = np.full(len(around), CLUSTERS - 1, np.int64)
    if len(seen) <= CLUSTERS:
        return cluster
    rows = np.sqrt(around[seen])
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    centre = rows[np.random.default_rng(5).choice(len(seen), CLUSTERS - 1, replace=False)]
    for _ in range(12):
        best = (rows @ centre.T).argmax(1)
        for c in range(CLUSTERS - 1):
            if (best == c).any():
                centre[c] = rows[best == c].mean(0)
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
    cluster[seen] = best
    return cluster


def grouped(counts: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(input of each id, class of each id) by counts of ids and of what stands around them."""
    order = np.argsort(-counts, kind="stable")
    cluster = _clusters(around)
    class_of, input_of = OWN_CLASSES + cluster, OWN_INPUTS + cluster
    class_of[order[:OWN_CLASSES]] = np.arange(OWN_CLASSES)
    input_of[order[:OWN_INPUTS]] = np.arange(OWN_INPUTS)
    return input_of, class_of


def pair_counts(ids: list[np.ndarray], input_of: np.ndarray, class_of: np.ndarray, near: np.ndarray, far: np.ndarray) -> None:
    """Adds, in place, what stands just before each id to `near`, and what is further back to `far` (both flat)."""
    end = len(class_of) - 1
    gap = np.full(max(FAR), end, np.uint16)
    flat = np.concatenate([p for i in ids for p in (gap, i)])
    x, y = input_of[flat] * CLASSES, class_of[flat]
    sizes = np.array(list(map(len, ids)))
    at = places(np.cumsum(sizes + len(gap)) - sizes, sizes)
    y, ones = y[at], np.ones(len(at), near.dtype)  # numpy adds an array in place sooner than a number
    np.add.at(near, x[at - 1] + y, ones)
    for d in FAR:
        np.add.at(far, x[at - d] + y, ones)


def build(counts: np.ndarray, input_of: np.ndarray, class_of: np.ndarray, near: np.ndarray, far: np.ndarray) -> Model:
    """The model of counted tables (inputs, classes), its attention weights not fitted yet."""
    smooth = counts + 0.1
    total = np.bincount(class_of, smooth, CLASSES) + 1e-9
    share = np.log(smooth / total[class_of])
    plain = (total / total.sum()).astype(np.float32)
    tables = [((n + k * plain) / (n.sum(1, keepdims=True) + k)).astype(np.float32) for n, k in ((near, 5), (far, 100))]
    return Model(first_weights(), input_of, class_of, share.astype(np.float32), *tables, plain)


def log_ids(m: Model, ids: list[np.ndarray], pull: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Natural log probabilities of all ids of all texts, laid end to end; texts come with their end."""
    pull = pull or pulls(m.weights)
    seen, target, use, _ = windows(ids, len(m.class_of) - 1)
    out = log_class(m, pull, m.input_of[seen], m.class_of[target])
    out += m.log_share[target]
    return out.T[use.T].astype(np.float64)


def score_texts(m: Model, ids: list[np.ndarray], words: list[np.ndarray], sizes: np.ndarray, share: np.ndarray, pull=None) -> np.ndarray:
    """Natural log probability of each text: its words (numbers, with the end's), of `sizes` ids and log `share` by number."""
    flat = np.concatenate(words)
    own = np.add.reduceat(log_ids(m, ids, pull), np.cumsum(sizes[flat]) - sizes[flat])
    share = share[flat]
    mixed = np.log(OF_IDS * np.exp(own - share) + (1 - OF_IDS)) + share  # a share is no less than one word's of all
    return np.add.reduceat(mixed, np.cumsum([0, *map(len, words[:-1])]))


# --- over the corpus -----------------------------------------------------------------------------------------------


def places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of `size` places each, laid end to end."""
    at = np.cumsum(size)
    return np.repeat(start - (at - size), size) + np.arange(int(size.sum()))


class _Words(defaultdict):
    """word -> number, from 0 for the end; of each number the ids, laid end to end, and how often training texts have it."""

    def __init__(self, encode, end: int):
        super().__init__(count().__next__)
        self.encode = encode
        self.flat, self.sizes = bytearray(np.uint16(end).tobytes()), array("i", [1])
        self.counts = np.zeros(1, np.int64)
        self[END_WORD]  # takes number 0

    def look_up(self, texts: list[list[bytes]], learn: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(numbers of each text's words and end, ids of each text and its end); counts words of texts to learn from."""
        flat = pa.array(list(chain.from_iterable(texts)), pa.binary())
        return self.look_up_all(flat, np.array(list(map(len, texts))), learn)

    def look_up_all(self, words: pa.Array, lengths: np.ndarray, learn: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """As `look_up`, of the words of all texts, laid end to end, and how many each text has: each different one is asked for once."""
        words, lengths = words.dictionary_encode(), lengths + 1
        each, known = words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist(), len(self)
        numbers = np.fromiter(map(self.__getitem__, each), np.int64, len(each))
        nos, inside = np.zeros(lengths.sum(), np.int64), np.ones(lengths.sum(), bool)
        inside[np.cumsum(lengths) - 1] = False  # the end has number 0
        nos[inside] = numbers[words.indices.to_numpy()]
        if len(self) > known:
            ids, sizes = self.encode([*islice(reversed(self), len(self) - known)][::-1])
            self.flat += ids.tobytes()
            self.sizes.frombytes(sizes.astype(np.int32).tobytes())
        size = np.frombuffer(self.sizes, np.int32).astype(np.int64)
        start = np.cumsum(size) - size
        at = np.cumsum(size[nos])
        ids = np.frombuffer(bytes(self.flat), np.uint16)[places(start[nos], size[nos])]
        ends = np.cumsum(lengths)
        new = np.bincount(nos[np.repeat(learn, lengths)], minlength=len(self.sizes))
        new[: len(self.counts)] += self.counts
        self.counts = new
        return np.split(nos.astype(np.uint32), ends[:-1]), np.split(ids, at[ends - 1][:-1])


@lru_cache(maxsize=1)
def _squeeze() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=1)


def packed(nos: np.ndarray) -> bytes:
    """Word numbers as bytes: planes of equal bytes of all numbers, compressed."""
    return _squeeze().compress(nos.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4")[:, 0]


ENCODED = "block long, doc_id {}, ids binary, nos binary, sizes binary, key long, word binary, c long"


def encoded(docs: DataFrame, learn: Column, path: str) -> DataFrame:
    """Blocks of texts, written. A row is a document (block, doc_id, its packed word numbers, and where it is a training
    document its ids as uint16 bytes), a block's sizes (block, the number of ids and the ids of its words, packed), or a
    word of a block (key: block and number; word; its count c in training documents of the block)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, size = many_subwords(path), subwords(path)[1]
        block, known, held = TaskContext.get().partitionId() << GENERATION_BITS, _Words(encode, size - 1), 0
        kinds = {"block": pa.int64(), "doc_id": None, "ids": pa.binary(), "nos": pa.binary(), "sizes": pa.binary()}
        kinds |= {"key": pa.int64(), "word": pa.binary(), "c": pa.int64()}

        def rows(n: int, **given: pa.Array) -> pa.RecordBatch:
            columns = [given[k] if k in given else pa.nulls(n, t) for k, t in kinds.items()]
            return pa.RecordBatch.from_arrays(columns, list(kinds))

        def ended() -> Iterator[pa.RecordBatch]:
            sizes = zlib.compress(np.frombuffer(known.sizes, np.int32).tobytes() + bytes(known.flat), 1)
            yield rows(1, block=pa.array([block]), sizes=pa.array([sizes], pa.binary()))
            all_words = list(known)
            for at in range(0, len(all_words), 50_000):
                own, c = all_words[at : at + 50_000], known.counts[at : at + 50_000]
                keys = (block << NUMBER_BITS) + np.arange(at, at + len(own))
                yield rows(len(own), key=pa.array(keys), word=pa.array(own, pa.binary()), c=pa.array(c))

        for b in batches:
            kinds["doc_id"] = b.schema.field(0).type
            for at in range(0, b.num_rows, DOCS):
                part = b.slice(at, DOCS)
                teaches = np.array(part.column(1).to_pylist(), bool)
                nos, ids = known.look_up_all(*words_in(part.column(2)), teaches)
                yield rows(
                    len(nos),
                    block=pa.array(np.full(len(nos), block)),
                    doc_id=part.column(0),
                    ids=pa.array([i.tobytes() if t else None for i, t in zip(ids, teaches, strict=True)], pa.binary()),
                    nos=pa.array(list(map(packed, nos)), pa.binary()),
                )
                held += sum(4 * len(n) + 2 * len(i) for n, i in zip(nos, ids, strict=True))
                if len(known) > BLOCK_WORDS or held > BLOCK_BYTES:
                    yield from ended()
                    block, known, held = block + 1, _Words(encode, size - 1), 0
        if held:
            yield from ended()

    chosen = docs.select("doc_id", F.coalesce(learn, F.lit(False)).alias("learn"), "text")
    return written(chosen.mapInArrow(run, ENCODED.format(kind)), "lm-blocks")


def counted(blocks: DataFrame) -> DataFrame:
    """(key, total, first), written: total is the word's count over all blocks; first is true once for a word."""
    same = Window.partitionBy("word")
    words = blocks.where("word IS NOT NULL").select("key", "word", "c")
    found = words.withColumns({"total": F.sum("c").over(same), "first": F.col("key") == F.min("key").over(same)})
    return written(found.select("key", "total", "first"), "lm-words")


def summed(rows: DataFrame, function, kind: type) -> dict[int, np.ndarray]:
    """Sums, by k, of the arrays (k, blob of `kind`) that `function` gives for a task's batches; k is bounded.

    Whole arrays travel, not their cells; each task keeps one sum for each of its k.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ks, blobs = [], []
        for k, a in function(batches):
            ks.append(k)
            blobs.append(np.ascontiguousarray(a, kind).tobytes())
            if len(ks) == 256:
                yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array(blobs, pa.binary())], ["k", "blob"])
                ks, blobs = [], []
        if ks:
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array(blobs, pa.binary())], ["k", "blob"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                a = np.frombuffer(blob, kind)
                if k in held:
                    held[k] += a
                else:
                    held[k] = a.astype(np.float64)
        for k, a in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([a.tobytes()], pa.binary())], ["k", "blob"])

    told = rows.mapInArrow(made, "k int, blob binary").repartition("k").mapInArrow(add, "k int, blob binary").toArrow()
    return {k: np.frombuffer(b, np.float64) for k, b in zip(told["k"].to_pylist(), told["blob"].to_pylist(), strict=True)}


def _by_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    for b in batches:
        for at in range(0, b.num_rows, DOCS):
            yield [np.frombuffer(x, np.uint16) for x in b.column(0).slice(at, DOCS).to_pylist()]


def id_counts(learned: DataFrame, size: int) -> np.ndarray:
    def run(batches):
        n = np.zeros(size, np.int64)
        for ids in _by_docs(batches):
            n += np.bincount(np.concatenate(ids), minlength=size)
        yield 0, n

    return summed(learned, run, np.int64).get(0, np.zeros(size))


def _around(learned: DataFrame, counts: np.ndarray) -> np.ndarray:
    """(ids, 2 (AROUND + 1)) counts over all documents; ids that are inputs and classes of their own need none."""
    order = np.argsort(-counts, kind="stable")
    number, size = _numbers(order), len(counts)
    wide = 2 * (int(number.max()) + 1)
    needed = np.zeros(size, bool)
    needed[order[min(OWN_INPUTS, OWN_CLASSES) :]] = True

    def run(batches):
        around = np.zeros(size * wide, np.int32)
        for ids in _by_docs(batches):
            around_counts(ids, number, needed, around)
        table_ = around.reshape(size, wide)
        for k in np.flatnonzero(table_.any(1)).tolist():
            yield k, table_[k]

    out = np.zeros((size, wide), np.float32)
    for k, row in summed(learned, run, np.int32).items():
        out[k] = row
    return out


def _pair_tables(learned: DataFrame, input_of: np.ndarray, class_of: np.ndarray) -> list[np.ndarray]:
    """The two tables of counts over all documents."""

    def run(batches):
        tables = np.zeros((2, INPUTS * CLASSES), np.int32)  # half as wide as sums, so more of them stays in the cache
        held: list[np.ndarray] = []
        size = counted_ids = 0

        def rows():
            by_row = tables.reshape(2 * INPUTS, CLASSES)
            for k in np.flatnonzero(by_row.any(1)).tolist():
                yield k, by_row[k]

        for ids in _by_docs(batches):
            held += ids
            size += sum(map(len, ids))
            if size > COUNTED:
                if counted_ids + size > MOST_COUNTED:
                    yield from rows()
                    tables[:], counted_ids = 0, 0
                pair_counts(held, input_of, class_of, *tables)
                held, size, counted_ids = [], 0, counted_ids + size
        if held:
            pair_counts(held, input_of, class_of, *tables)
        yield from rows()

    out = np.zeros((2 * INPUTS, CLASSES))
    for k, row in summed(learned, run, np.int32).items():
        out[k] = row
    return [out[:INPUTS], out[INPUTS:]]


def fitted(m: Model, learned: DataFrame) -> Weights:
    """Weights that each task descends to from m's over all its windows, averaged by how many those were."""
    shared = learned.sparkSession.sparkContext.broadcast(m)
    end, n_offsets = len(m.class_of) - 1, len(m.weights.offset)

    def run(batches):
        m = shared.value
        m = replace(m, weights=Weights(*(p.copy() for p in (m.weights.query, m.weights.key, m.weights.offset))))
        sums, held, size, seen, step = no_sums(m.weights), [], 0, 0, STEP

        def down():
            x, y, use = (np.concatenate(c, axis=1).T for c in zip(*held, strict=True))
            return descend(m, sums, m.input_of[x], m.class_of[y], use, step)

        for ids in _by_docs(batches):
            held.append(windows(ids, end)[:3])
            size += held[-1][0].shape[1]
            if size >= FIT_HELD:
                step, seen = down(), seen + size
                held, size = [], 0
        if size:
            step, seen = down(), seen + size
        if seen:
            w = m.weights
            for k in range(INPUTS):
                yield k, np.concatenate([[1.0], w.query[k], w.key[k]]) * seen
            yield INPUTS, np.concatenate([[1.0], w.offset]) * seen

    told = summed(learned, run, np.float64)
    if not told:
        return m.weights
    rows = np.stack([told[k][1:] / told[k][0] for k in range(INPUTS)]).astype(np.float32)
    offset = (told[INPUTS][1:] / told[INPUTS][0]).astype(np.float32)
    assert len(offset) == n_offsets
    return Weights(np.ascontiguousarray(rows[:, :WIDTH]), np.ascontiguousarray(rows[:, WIDTH:]), offset)


def train(blocks: DataFrame, path: str) -> Model:
    """The model of the training documents of encoded blocks."""
    learned = blocks.where("ids IS NOT NULL").select("ids")
    counts = id_counts(learned, subwords(path)[1])
    input_of, class_of = grouped(counts, _around(learned, counts))
    m = build(counts, input_of, class_of, *_pair_tables(learned, input_of, class_of))
    m.weights = fitted(m, learned)
    return m


def score_documents(docs: DataFrame, learn: Column | None = None, tokenizer: str | None = None) -> DataFrame:
    """For each row: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    `learn` says which rows are training documents (none given: all; null counts as false). A null text counts as empty:
    its end alone is scored. Repeated rows are scored each; other columns are ignored. With no training documents the
    base score is 0 and classes are even. An empty table gives an empty result.
    """
    spark, path = docs.sparkSession, tokenizer or default_tokenizer()
    ship(spark)
    small_batches(spark, 500)
    blocks = encoded(docs, F.lit(True) if learn is None else learn, path)
    words = counted(blocks)
    held = F.when(F.col("first"), F.col("total"))
    n, v = words.agg(F.coalesce(F.sum(held), F.lit(0)), F.count_if(held > 0)).first()
    shared = spark.sparkContext.broadcast(train(blocks, path))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    log_all, ten = np.log(n + v + 1), np.log(10)

    def run(own_docs: pa.Table, own_words: pa.Table) -> pa.Table:
        m = shared.value
        pull = pulls(m.weights)
        (sizes,) = own_docs["sizes"].drop_null().to_pylist()
        own_docs = own_docs.filter(own_docs["nos"].is_valid())
        no = own_words["no"].to_numpy()
        total = np.zeros(len(no), np.int64)
        total[no] = own_words["total"].to_numpy()
        share = np.log(total + 1) - log_all
        sizes = zlib.decompress(sizes)
        sizes, flat_ids = np.frombuffer(sizes, np.int32, len(no)).astype(np.int64), np.frombuffer(sizes, np.uint16, offset=4 * len(no))
        start = np.cumsum(sizes) - sizes
        words_ = list(map(unpacked, own_docs["nos"].to_pylist()))
        n_ids = [int(sizes[w].sum()) for w in words_]
        score, base, known = (np.empty(len(words_)) for _ in range(3))
        at = 0
        while at < len(words_):  # by about 100,000 ids at once
            upto, held = at + 1, n_ids[at]
            while upto < len(words_) and held + n_ids[upto] < 100_000:
                held += n_ids[upto]
                upto += 1
            part = words_[at:upto]
            flat, starts = np.concatenate(part), np.cumsum([0, *map(len, part[:-1])])
            ids = np.split(flat_ids[places(start[flat], sizes[flat])], np.cumsum(n_ids[at : upto - 1]))
            score[at:upto] = score_texts(m, ids, part, sizes, share, pull) / ten
            base[at:upto] = np.add.reduceat(share[flat], starts) / ten
            known[at:upto] = np.add.reduceat((total[flat] > 0).astype(np.int64), starts)
            at = upto
        columns = {
            "doc_id": own_docs["doc_id"],
            "n_tokens": pa.array([len(w) for w in words_], pa.int64()),
            "n_known": pa.array(known.astype(np.int64)),
            "train_tokens": pa.array(np.full(len(words_), n, np.int64)),
            "base_score": pa.array(base if n else np.zeros(len(words_))),
            "score": pa.array(score),
        }
        return pa.table(columns)

    texts = blocks.where("word IS NULL").select("block", "doc_id", "nos", "sizes")
    number = F.col("key").bitwiseAND(F.lit((1 << NUMBER_BITS) - 1)).cast("int")
    counts = words.select(F.shiftright("key", NUMBER_BITS).alias("block"), number.alias("no"), "total")
    return texts.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(run, out)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder("doc_id", 7) == 2
    scored = score_documents(docs, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), *scored.columns[1:])
