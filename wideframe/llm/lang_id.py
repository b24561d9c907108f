"""Language ID (operator 3): multinomial naive Bayes over hashed character n-grams.

Counts of hashed 1-, 2- and 3-grams are summed over all training documents; the log-probability matrix (languages x
buckets) is broadcast, its size bounded by the number of languages; batches of texts are scored in numpy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, ship, small_batches, table

BUCKETS = 1 << 15
#: Code points that are hashed at once, so memory stays bounded for any text.
CHUNK = 150_000
UNDETERMINED = "und"
#: Posterior below which the pipeline takes a document to be in none of the languages.
LEAST_SCORE = 0.4
#: Letters, and some numbers that are no digits, such as ½.
_WORDLIKE = re.compile(r"[^\W\d_]")
_PAD = 2


def has_letter(text: str) -> bool:
    """Whether a character is a letter to Unicode (str.isalpha)."""
    return any(m[0].isalpha() for m in _WORDLIKE.finditer(text))


def _grams(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Buckets (3, n) of the grams that start at each code; BUCKETS for those on a text's two pad codes."""
    a = codes * np.uint32(0x9E3779B1)
    b, c = np.roll(codes, -1), np.roll(codes, -2)
    two = (a ^ (a >> np.uint32(15))) + b * np.uint32(0x85EBCA77)
    three = (two ^ (two >> np.uint32(13))) * np.uint32(0xC2B2AE3D) + c * np.uint32(0x27D4EB2F)
    out = np.empty((3, len(codes)), np.int32)
    for row, h in enumerate((a, two * np.uint32(0x165667B1), three)):
        out[row] = ((h ^ (h >> np.uint32(16))) & np.uint32(BUCKETS - 1)).astype(np.int32)
    for k in range(1, _PAD + 1):
        out[:, ends - k] = BUCKETS
    return out


def chunks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text for each part, grams (3, n), ends of the parts); long texts come in overlapping parts."""
    held, ids, size = [], [], 0
    for i, t in enumerate(texts):
        if not t:
            continue
        codes = np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        for at in range(0, len(codes), CHUNK):
            part = codes[at : at + CHUNK + _PAD]
            short = _PAD - max(0, len(part) - min(CHUNK, len(codes) - at))
            held.append(np.append(part, np.full(short, 32, np.uint32)))
            ids.append(i)
            size += len(held[-1])
            if size >= CHUNK:
                ends = np.cumsum([len(x) for x in held])
                yield np.array(ids), _grams(np.concatenate(held), ends), ends
                held, ids, size = [], [], 0
    if held:
        ends = np.cumsum([len(x) for x in held])
        yield np.array(ids), _grams(np.concatenate(held), ends), ends


@dataclass
class Model:
    languages: list[str]
    #: (BUCKETS + 1, languages): log probabilities; the last row, of no gram, is 0.
    log_p: np.ndarray
    prior: np.ndarray

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        total = np.zeros((len(texts), len(self.languages)))
        for ids, grams, ends in chunks(texts):
            starts = np.append(0, ends[:-1])
            for row in grams:
                np.add.at(total, ids, np.add.reduceat(self.log_p[row], starts, axis=0, dtype=np.float64))
        total += self.prior
        best = total.argmax(1)
        p = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        known = [bool(t) and has_letter(t) for t in texts]
        return (
            [self.languages[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)],
            [float(x) if k else 0.0 for x, k in zip(p, known, strict=True)],
        )


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, np.ndarray] = {}
    for pdf in batches:
        for lang, group in pdf.groupby("lang")["text"]:
            mine = counts.setdefault(lang, np.zeros(BUCKETS + 2, np.int64))
            mine[-1] += len(group)
            for _, grams, _ in chunks(group.tolist()):
                mine[:-1] += np.bincount(grams.ravel(), minlength=BUCKETS + 1)
    for lang, n in counts.items():
        n[BUCKETS] = 0
        used = np.flatnonzero(n)
        yield pd.DataFrame({"lang": lang, "bucket": used, "n": n[used]})


def train(labelled: DataFrame, smoothing: float = 0.5) -> Model:
    """labelled: text, lang, over all of which counts are taken. Null texts or languages teach nothing."""
    ship(labelled.sparkSession)
    small_batches(labelled.sparkSession)
    rows = labelled.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    counted = rows.mapInPandas(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n"))
    found = counted.toPandas()  # at most languages x buckets rows
    found.columns = ["lang", "bucket", "n"]
    languages = sorted(found["lang"].unique())
    n = np.zeros((BUCKETS + 2, len(languages)))
    n[found["bucket"], np.searchsorted(languages, found["lang"])] = found["n"]
    grams, docs = n[:BUCKETS] + smoothing, n[-1] + 1
    log_p = np.vstack([np.log(grams / grams.sum(0)), np.zeros(len(languages))]).astype(np.float32)
    return Model(languages, np.ascontiguousarray(log_p), np.log(docs / docs.sum()))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and lang_score (the posterior, 0 to 1).

    A null or empty text, or one without a letter, is `und` with score 0, as all are if nothing was learned. Ties go
    to the first language by name. Columns of docs with the new names are replaced. Empty tables stay empty.
    """
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, lang_score double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            lang, p = shared.value.score(texts.tolist())
            yield pd.DataFrame({"lang_pred": lang, "lang_score": p})

    made = fresh(docs, "lang_made")
    keep = [c for c in docs.columns if c.lower() not in ("lang_pred", "lang_score")]
    return docs.select(*keep, score(text).alias(made)).select(*keep, f"{made}.lang_pred", f"{made}.lang_score")


def remainder(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def _trained(docs: DataFrame) -> Model:
    return train(docs.where(remainder("doc_id", 4) != 2))


def op3_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = _trained(docs.select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id",
        (remainder("doc_id", 4) == 2).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
    )


def keep_known(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A pipeline stage: documents without a language go (`und`, or no language has LEAST_SCORE of the posterior)."""
    scored = predict(docs, _trained(docs))
    return scored.where((F.col("lang_pred") != UNDETERMINED) & (F.col("lang_score") >= LEAST_SCORE)).select(*docs.columns)
