"""Language identification by multinomial naive Bayes over hashed character n-grams.

Training counts hashed character 2- and 3-grams per language inside the tasks, sums them in Spark, and hands the
log-probability matrix (languages x ``2**BITS`` float32, a size that does not depend on the number of documents) to the
executors as a broadcast. Scoring turns a batch of texts into one sparse matrix of counts (rows: texts, or blocks of
long ones; columns: features) and multiplies it by the matrix in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themelens.llm.common import body, chunks

#: Hashed features; languages x 2**15 x 4 bytes are broadcast (128 KB a language).
BITS = 15
#: Added to every count.
SMOOTHING = 0.5
#: Languages that are learned; their matrix has 2**15 x 4 bytes a language (64 MB for all of them).
LANGUAGES = 512
#: Nonzero entries of a batch's sparse matrix times languages that are multiplied at once.
PRODUCTS = 1 << 21
#: Characters that are turned into features at once.
BLOCK = 1 << 18

UNDETERMINED = "und"


def features(text: str) -> Iterator[np.ndarray]:
    """Feature numbers of all 2- and 3-grams of the lower-cased text, block by block."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    for start in range(0, max(len(codes) - 1, 0), BLOCK):
        part = codes[start : start + BLOCK + 2]
        pairs = part[:-1] * np.uint32(0x9E3779B1) + part[1:] * np.uint32(0x85EBCA6B)
        triples = pairs[:-1] * np.uint32(0xC2B2AE35) + part[2:] * np.uint32(0x27D4EB2F)
        mixed = np.concatenate([pairs[:BLOCK], triples[:BLOCK] ^ np.uint32(0x165667B1)])
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        yield mixed >> np.uint32(32 - BITS)


def sparse(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a block in ascending order, and how often each occurs."""
    if len(block) < 1 << (BITS - 2):
        return np.unique(block, return_counts=True)
    counts = np.bincount(block, minlength=1 << BITS)
    at = np.flatnonzero(counts)
    return at, counts[at]


class TooManyLanguagesError(ValueError):
    """More values of the language column than the model's stated limit."""


@dataclass(frozen=True)
class Model:
    """Learned values in ascending order; ``weights[feature, language]``; log share of each language's documents."""

    languages: tuple[str, ...]
    weights: np.ndarray
    prior: np.ndarray

    def totals(self, texts: list[str]) -> np.ndarray:
        """Joint log probability of each text with each language; a text's sums do not depend on its batch."""
        found = np.tile(self.prior, (len(texts), 1))
        rows: list[int] = []
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def multiply() -> None:
            starts = np.cumsum([0] + [len(at) for at, _ in parts[:-1]])
            values = self.weights[np.concatenate([at for at, _ in parts])].astype(np.float64)
            values *= np.concatenate([n for _, n in parts])[:, None]
            np.add.at(found, rows, np.add.reduceat(values, starts, axis=0))
            rows.clear()
            parts.clear()

        for row, text in enumerate(texts):
            for block in features(text):
                if len(block):
                    rows.append(row)
                    parts.append(sparse(block))
                    held += len(parts[-1][0])
                    if held * len(self.languages) > PRODUCTS:
                        multiply()
                        held = 0
        if parts:
            multiply()
        return found

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Most probable language, the first in order of ties, and its posterior; ``und``, 0.0 without a letter."""
        found = [(UNDETERMINED, 0.0)] * len(texts)
        places = [k for k, text in enumerate(texts) if text and any(map(str.isalpha, text))]
        if not self.languages or not places:
            return found
        total = self.totals([texts[k] for k in places])
        best = total.argmax(axis=1)
        score = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        for k, language, value in zip(places, best.tolist(), score.tolist(), strict=True):
            found[k] = (self.languages[language], value)
        return found


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Fit on all rows with a language and a text. No rows: a model that answers ``und``.

    More than ``LANGUAGES`` values raise ``TooManyLanguagesError`` before any feature is counted.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")
    )
    known = rows.select("lang").distinct().limit(LANGUAGES + 1).count()
    if known > LANGUAGES:
        raise TooManyLanguagesError(f"more than {LANGUAGES} languages")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in chunks(batches):
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = counts.setdefault(name, np.zeros(1 << BITS, np.int64))
                seen[name] = seen.get(name, 0) + 1
                for block in features(value):
                    own += np.bincount(block, minlength=1 << BITS)
        for name, own in counts.items():
            at = np.flatnonzero(own)
            numbers = np.append(at, -1).astype(np.int32)  # -1 carries the number of documents
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(numbers)), pa.array(numbers), pa.array(np.append(own[at], seen[name]))],
                ["lang", "feature", "n"],
            )

    summed = (
        rows.mapInArrow(count, "lang string, feature int, n long")
        .groupBy("lang", "feature")
        .agg(F.sum("n").alias("n"))
        .toArrow()  # at most languages x (2**BITS + 1) rows
    )
    names, numbers, values = (summed.column(k).to_numpy() for k in ("lang", "feature", "n"))
    languages = tuple(sorted(set(names)))
    counts = np.zeros(((1 << BITS) + 1, len(languages)))
    counts[numbers, np.searchsorted(languages, names) if languages else []] = values
    grams = counts[:-1] + SMOOTHING
    return Model(
        languages,
        np.log(grams / grams.sum(axis=0)).astype(np.float32),
        np.log(counts[-1] / max(counts[-1].sum(), 1)),
    )


def predict(docs: DataFrame, model: Model, *, text: str = "text", row: str = "row") -> DataFrame:
    """Column ``row`` unchanged, ``lang_pred`` and ``score`` of each row; nothing but the text decides."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(row).alias("row"), F.col(text).alias("text"))
    schema = rows.select("row", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in chunks(batches):
            found = own.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([name for name, _ in found], pa.string()),
                    pa.array([value for _, value in found], pa.float64()),
                ],
                ["row", "lang_pred", "score"],
            )

    return rows.mapInArrow(score, schema)


def remainder(doc_id: str = "doc_id"):
    """crc32 of the id as text modulo 3; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document.

    Documents whose id gives remainder 1 are held out from training. A null id has no remainder: such a row is not held
    out and not learned from.
    """
    part = remainder()
    model = train(docs.where(part != 1))
    rows = docs.select(
        F.struct("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out")).alias("row"), F.col("text")
    )
    return predict(rows, model).select("row.doc_id", "row.held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """Documents with a determined language, all columns; texts that are null or without a letter are rejected.

    Without any row to learn from no language is known, and what has a letter stays. Repeated rows stay repeated.
    """
    model = train(docs.where(remainder() != 1))
    rows = docs.select(F.struct("*").alias("row"), body().alias("text"))
    if not model.languages:
        return rows.where(F.regexp_like("text", F.lit(r"\p{L}"))).select("row.*")
    return predict(rows, model).where(F.col("lang_pred") != UNDETERMINED).select("row.*")
