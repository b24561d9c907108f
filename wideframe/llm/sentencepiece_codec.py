"""SentencePiece encoding and decoding (operator 9) by streaming Viterbi.

The lattice has a state for each character boundary and an arc for each piece that ends there; an automaton over the
pieces finds these as the characters come. Only the states within the longest piece of the last boundary can begin a
further arc, so that is the window kept; whenever the backpointer paths of all of these meet in one boundary, the ids up
to it are committed and their states dropped.

Where no piece of the model goes over a word's end (or from letters to other characters), all paths meet there whatever
comes before: such a boundary is committed at once, and what a word between two of them gives is remembered, so that the
lattice is laid once for a word. A word that is longer than several windows is not waited for: its characters go through
the window as they come.

For a unigram model a state keeps the best sum of scores. For a BPE model the score order of merges decides instead: the
state's arc is the piece that ends the BPE of the text so far, and it is the one whose neighbour before it stays apart
from it when both are merged again. So both kinds give the ids of the SentencePiece library.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import fresh, ship, small_batches, table

SPACE = "▁"
#: Words, units that they consist of, and pairs of pieces that a worker remembers: the last so many, and at most twice.
CACHED = 250_000
#: Ids that are turned into bytes at once.
DECODED = 1 << 16
#: Characters that a stream is given at once, and windows of a word whose end is waited for.
PORTION, WAITED = 1 << 16, 8
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
_UNK_PENALTY = 10.0
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _varint(b: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (b[at] & 0x7F) << shift
        shift += 7
        at += 1
        if b[at - 1] < 0x80:
            return value, at


def _fields(b: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0
    while at < len(b):
        key, at = _varint(b, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(b, at)
        else:
            n = {1: 8, 5: 4}.get(kind)
            if n is None:
                n, at = _varint(b, at)
            value, at = b[at : at + n], at + n
        yield key >> 3, value


class Recent:
    """What was put in or asked for last: at least `most` keys, at most twice as many."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def __len__(self) -> int:
        return len(self.new) + len(self.old)

    def put(self, key, value) -> None:
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        self.new[key] = value

    def older(self, key):
        """The value of a key that `new` has not (None: forgotten), which counts as the latest again."""
        found = self.old.pop(key, None)
        if found is not None:
            self.put(key, found)
        return found


class Model:
    """A model file: pieces, scores, kinds, and what its normaliser does. One with a character map is refused."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.pieces, self.scores, self.kinds = [], [], []
        self.type, self.dummy_prefix, self.squeeze = UNIGRAM, True, True
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode("utf-8"))
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.kinds.append(own.get(3, NORMAL))
            elif number == 2:
                self.type = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                own = dict(_fields(value))
                if own.get(2):
                    raise ValueError("a model with a normalisation map is not supported")
                self.dummy_prefix, self.squeeze = bool(own.get(3, 1)), bool(own.get(4, 1))
                if not own.get(5, 1):
                    raise ValueError("a model that does not escape white space is not supported")
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] in (NORMAL, USER_DEFINED)}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        self.longest = max(map(len, self.ids))
        self.size = [len(p) for p in self.pieces]
        self._lay_out()
        # Where no piece lies across two kinds of neighbours, a text falls into units that are encoded by themselves.
        self.by_words = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        mixed = re.compile(f"[{LATIN}][^{LATIN}]|[^{LATIN}{SPACE}][{LATIN}]")
        by_kind = f"{SPACE}*[{LATIN}]+|{SPACE}*[^{LATIN}{SPACE}]+|{SPACE}+"
        by_space = f"{SPACE}*[^{SPACE}]+|{SPACE}+"
        self.units = re.compile(by_space if any(map(mixed.search, self.ids)) else by_kind).findall
        self.apart = Recent(CACHED)
        self.least = min(self.scores) - _UNK_PENALTY
        self.raw = [
            bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN
            else p.replace(SPACE, " ").encode()
            for p, k in zip(self.pieces, self.kinds, strict=True)
        ]

    def _lay_out(self) -> None:
        """An automaton: a state for each beginning of a piece, the longest that the text so far ends in.

        `onward` has a state's next ones by character, `shorter` the state of the next shorter beginning, `ending` the
        ids of all pieces that the text then ends in, the longest first.
        """
        self.onward, self.shorter, self.ending = [{}], [0], [()]
        for p, i in self.ids.items():
            at = 0
            for c in p:
                to = self.onward[at].get(c)
                if to is None:
                    to = self.onward[at][c] = len(self.onward)
                    self.onward.append({})
                    self.shorter.append(0)
                    self.ending.append(())
                at = to
            self.ending[at] = (i,)
        level = [0]
        while level:  # by length, so that shorter beginnings are done
            for at in level:
                for c, to in self.onward[at].items():
                    if at:
                        self.shorter[to] = self.after(self.shorter[at], c)
                    self.ending[to] += self.ending[self.shorter[to]]
            level = [to for at in level for to in self.onward[at].values()]
        none: dict[str, int] = {}
        self.onward = [x or none for x in self.onward]

    def after(self, state: int, c: str) -> int:
        """The state that a character leads to."""
        while (to := self.onward[state].get(c)) is None:
            if not state:
                return 0
            state = self.shorter[state]
        return to

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if text and self.dummy_prefix:
            text = " " + text
        return text.replace(" ", SPACE)

    def fallback(self, c: str) -> tuple[int, ...]:
        """The ids of a character that is no piece."""
        return tuple(self.bytes[b] for b in c.encode("utf-8", "surrogatepass")) if self.bytes else (self.unknown,)

    def merge(self, s: str) -> list[str]:
        """BPE of a short string, by the merges themselves: the best pair first, the leftmost of equals."""
        parts = list(s)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether piece a (-1: none) and piece b after it are what BPE leaves of both."""
        pair = a << 32 | b
        found = self.apart.older(pair)
        if found is None:
            left, right = ([] if a < 0 else [self.pieces[a]]), self.pieces[b]
            found = self.merge("".join(left) + right) == [*left, right]
            self.apart.put(pair, found)
        return found


class Stream:
    """Takes characters in any portions and gives ids as soon as they are certain.

    It holds the window of the lattice and the word that has not ended yet, which are bounded; `commits` counts the
    boundaries that were committed before the text's end.
    """

    def __init__(self, model: Model):
        self.m, self.code = model, "H" if len(model.pieces) <= 1 << 16 else "I"
        self.words, self.units = Recent(CACHED), Recent(CACHED)
        self.commits, self.held, self.open = 0, "", False
        self._new_window()

    def _new_window(self) -> None:
        #: For each boundary since the last commit: where its arc begins, its piece (-1: a character that is none, or
        #: the text's start), its score.
        self.text, self.back, self.last, self.score = "", [0], [-1], [0.0]
        self.state = 0

    def feed(self, chars: str) -> list[int]:
        return np.frombuffer(self.push(chars), self.code).tolist()

    def finish(self) -> list[int]:
        return np.frombuffer(self.close(), self.code).tolist()

    def push(self, chars: str) -> bytes:
        """The ids that are certain now, as an array's bytes."""
        if not self.m.by_words:
            return self._through(chars)
        done = b""
        if self.open:
            end = chars.find(SPACE)
            if end < 0:
                return self._through(chars)
            done, chars = self._through(chars[:end]) + self._rest(), chars[end:]
            self.commits += 1
        s = self.held + chars
        cut = max(0, s.rfind(SPACE))
        while cut and s[cut - 1] == SPACE:
            cut -= 1
        self.held = s[cut:]
        if cut:
            done += self._whole(s[:cut])
        if len(self.held) > WAITED * self.m.longest:
            word, self.held, self.open = self.held, "", True
            done += self._through(word)
        return done

    def close(self) -> bytes:
        """The ids of what is left; the next text begins."""
        word, self.held = self.held, ""
        return self._rest() + (self._whole(word) if word else b"")

    def _whole(self, s: str) -> bytes:
        """Of whole words, each committed."""
        if s[0] == SPACE and SPACE + SPACE not in s:
            known, parts = self.words.new.get, s.split(SPACE)[1:]
            self.commits += len(parts)
            return b"".join([known(w) or self._word(w) for w in parts])
        parts = self.m.units(s)
        self.commits += len(parts)
        return b"".join(map(self._unit, parts))

    def _word(self, w: str) -> bytes:
        """Of a word without its space."""
        found = self.words.older(w)
        if found is None:
            first, *rest = self.m.units(SPACE + w)
            if rest:  # what it begins with may be a word of its own, and is remembered as that
                found = (self.words.new.get(first[1:]) or self._word(first[1:])) + b"".join(map(self._unit, rest))
            else:
                found = self._through(first) + self._rest()
            if len(w) <= 64:
                self.words.put(w, found)
        return found

    def _unit(self, s: str) -> bytes:
        found = self.units.new.get(s) or self.units.older(s)
        if found is None:
            found = self._through(s) + self._rest()
            if len(s) <= 64:
                self.units.put(s, found)
        return found

    def _through(self, chars: str) -> bytes:
        """Characters through the window: the lattice grows, and is cut where all paths meet."""
        out: list[int] = []
        step = self.m.longest
        for k in range(0, len(chars), step):
            self.text += chars[k : k + step]
            (self._extend_bpe if self.m.type == BPE else self._extend_unigram)()
            if len(self.text) > step:
                out += self._commit()
        return array(self.code, out).tobytes() if out else b""

    def _rest(self) -> bytes:
        out = array(self.code, self._path(len(self.text))).tobytes()
        self.open = False
        self._new_window()
        return out

    def _extend_bpe(self) -> None:
        text, back, last, state = self.text, self.back, self.last, self.state
        m, known = self.m, self.m.apart.new.get
        onward, shorter, ending, size = m.onward, m.shorter, m.ending, m.size
        for end in range(len(back), len(text) + 1):
            c = text[end - 1]
            while (to := onward[state].get(c)) is None and state:
                state = shorter[state]
            state = to or 0
            for i in ending[state]:
                begin = end - size[i]
                if begin < 0:  # before the last commit
                    continue
                before = last[begin]
                apart = known(before << 32 | i)
                if apart is None:
                    apart = m.stay_apart(before, i)
                if apart:
                    back.append(begin)
                    last.append(i)
                    break
            else:
                back.append(end - 1)
                last.append(-1)
        self.state = state

    def _extend_unigram(self) -> None:
        m, text, back, last, score = self.m, self.text, self.back, self.last, self.score
        for end in range(len(back), len(text) + 1):
            self.state = m.after(self.state, text[end - 1])
            best, arc = score[end - 1] + m.least, (end - 1, -1)
            for i in reversed(m.ending[self.state]):
                at = end - m.size[i]
                if at < 0:
                    break
                if at == end - 1 and arc[1] < 0 or score[at] + m.scores[i] > best:
                    best, arc = score[at] + m.scores[i], (at, i)
            back.append(arc[0])
            last.append(arc[1])
            score.append(best)

    def _path(self, high: int) -> list[int]:
        ids = []
        while high:
            i = self.last[high]
            if i < 0:
                ids += reversed(self.m.fallback(self.text[high - 1]))
            else:
                ids.append(i)
            high = self.back[high]
        ids.reverse()
        return ids

    def _commit(self) -> list[int]:
        """Follow the paths of all boundaries that a later piece can begin at, until they are at one boundary."""
        end = len(self.text)
        alive = set(range(max(0, end - self.m.longest + 1), end + 1))
        while len(alive) > 1:
            top = max(alive)
            alive.remove(top)
            alive.add(self.back[top])
        at = alive.pop()
        if not at:
            return []
        self.commits += 1
        out = self._path(at)
        self.text = self.text[at:]
        self.back = [0] + [b - at for b in self.back[at + 1 :]]
        self.last, self.score = self.last[at:], self.score[at:]
        return out


class Codec:
    def __init__(self, path: str):
        self.m = Model(path)
        self.stream = Stream(self.m)
        self.raw = np.frombuffer(b"".join(self.m.raw), np.uint8)
        self.raw_size = np.array([len(r) for r in self.m.raw])
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, which goes through the stream in portions."""
        s, stream = self.m.normalise(text), self.stream
        parts = [stream.push(s[at : at + PORTION]) for at in range(0, len(s), PORTION)]
        parts.append(stream.close())
        return np.frombuffer(b"".join(parts), stream.code)

    def decode_flat(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of lists of ids, laid end to end."""
        size, start = self.raw_size[ids], self.raw_start[ids]
        first = np.append(0, ends[:-1])
        first = first[first < ends]
        if self.m.dummy_prefix and len(first):  # the space before a text goes
            first = first[(size[first] > 0) & (self.raw[np.minimum(start[first], len(self.raw) - 1)] == 32)]
            size[first] -= 1
            start[first] += 1
        at, parts = np.cumsum(size), []
        for k in range(0, len(ids), DECODED):  # eight bytes for each byte of a part, however long a text is
            n = size[k : k + DECODED]
            where = np.repeat(start[k : k + DECODED] - (np.cumsum(n) - n), n)
            parts.append(self.raw[where + np.arange(len(where))].tobytes())
        data = b"".join(parts)
        cuts = np.append(0, at)[ends].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]

    def decode(self, ids: list[int]) -> str:
        return self.decode_flat(np.asarray(ids, np.int64), np.array([len(ids)]))[0]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(
    docs: DataFrame, model: str | None = None, text: str = "text", to: str = "ids", back: str | None = None
) -> DataFrame:
    """docs with the ids array<int> of each whole text. A null or empty text has none. A column named `to` is replaced.

    With `back`, a column of that name has the text that decoding the ids gives, as `decode` does (a null text's is
    empty); both are made by one Python process a task, where encode and decode in a row hold two.
    A model file with a character map for normalising is refused with a ValueError; so is one that keeps white space
    unescaped. An empty table gives an empty result.
    """
    path = model or default_model()
    ship(docs.sparkSession)
    small_batches(docs.sparkSession, 500)
    docs = docs.drop(to, back) if back else docs.drop(to)
    made = fresh(docs, "encoded_text")
    added = [StructField(to, ArrayType(IntegerType())), *([StructField(back, StringType())] if back else [])]
    schema = StructType([*docs.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            ids = [c.encode(t or "") for t in b.column(b.schema.get_field_index(made)).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)])
            flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
            columns = [*b.columns[:-1], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))]
            if back:
                columns.append(pa.array(c.decode_flat(flat, ends[1:]) if ids else [], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select("*", F.col(text).alias(made)).mapInArrow(run, schema)


def decode(coded: DataFrame, model: str | None = None, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """coded with the text of its ids; null ids give null. A space that the model puts before a text is taken off."""
    path = model or default_model()
    ship(coded.sparkSession)
    small_batches(coded.sparkSession, 500)
    coded = coded.drop(to)
    schema = StructType([*coded.schema.fields, StructField(to, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            column = b.column(b.schema.get_field_index(ids))
            sizes = np.array(column.value_lengths().fill_null(0), np.int64)
            flat = np.asarray(column.flatten(), np.int64)
            made = c.decode_flat(flat, np.cumsum(sizes)) if len(column) else []
            null = column.is_null().to_pylist()
            texts = pa.array([None if n else t for t, n in zip(made, null, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], [*b.schema.names, to])

    return coded.mapInArrow(run, schema)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether decoding them gives the text again (a text's own U+2581 comes back as a space)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = encode(docs, back="decoded")
    same = F.translate(F.coalesce("text", F.lit("")), SPACE, " ") == F.col("decoded")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", same.alias("round_trip"))
