"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point.  Rotating the vectors
of three neighbouring letters by two, one and no places and multiplying them binds
them into the vector of the n-gram; adding the vectors of all n-grams of a text bundles them
into its profile.  The prototype of a language is the bundle of its training texts, and a
text gets the language whose prototype has the largest cosine with its profile.

Letters are lower-cased; whatever is no letter ends a word, and a word has one blank on
either side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.llm.common import read_table, remainder, slices

UNDETERMINED = "und"
DIMENSIONS = 512
# More languages than this are taken for a mistake: their prototypes go to every task.
MOST_LANGUAGES = 2_000
_SEED = 20_011
_WORD = 21  # bits of a code point
_ROWS_KEPT = 1 << 15
_NGRAMS_AT_A_TIME = 1 << 13


class Profiles:
    """Vectors of letters and n-grams, made when first seen; one per task."""

    def __init__(self, dimensions: int = DIMENSIONS) -> None:
        self.dimensions = dimensions
        self.fold = np.full(0x110000, -1, np.int32)  # code point -> its letter, 0 for none
        self.turned: dict[tuple[int, int], np.ndarray] = {}
        self._forget()

    def _draw(self, letter: int) -> np.ndarray:
        bits = np.random.Generator(np.random.PCG64([_SEED, letter])).integers(
            0, 2, self.dimensions, dtype=np.int8)
        return bits * 2 - 1

    def _forget(self) -> None:
        self.codes, self.at = np.empty(0, np.int64), np.empty(0, np.int64)  # sorted; row of each
        self.rows = np.empty((1 << 10, self.dimensions), np.float32)

    def _letters(self, text: str) -> np.ndarray:
        """The letters of the text, each word with a zero before it, and a last zero."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        found = self.fold[points]
        if (found < 0).any():
            for p in np.unique(points[found < 0]).tolist():
                small = chr(p).lower()
                self.fold[p] = (ord(small) if len(small) == 1 else p) if chr(p).isalpha() else 0
            found = self.fold[points]
        found = np.concatenate(([0], found, [0]))
        keep = found != 0
        keep[1:] |= found[:-1] != 0
        return found[keep] if keep.any() else found[:0]

    def ngrams(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the n-grams of a text and how often each occurs; none without a letter."""
        letters = self._letters(text or "").astype(np.int64)
        if not letters.size:
            return letters, letters
        letters = np.concatenate(([0], letters))
        codes = (letters[:-2] << 2 * _WORD) | (letters[1:-1] << _WORD) | letters[2:]
        return np.unique(codes, return_counts=True)

    def _turned(self, letter: int, places: int) -> np.ndarray:
        if (letter, places) not in self.turned:
            self.turned[letter, places] = np.roll(self._draw(letter), places)
        return self.turned[letter, places]

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """One row for each code (sorted, distinct, _NGRAMS_AT_A_TIME at most)."""
        place = np.searchsorted(self.codes, codes)
        known = place < self.codes.size
        known[known] = self.codes[place[known]] == codes[known]
        if not known.all():
            if self.codes.size + codes.size > _ROWS_KEPT:
                self._forget()
                known[:] = False
            new, low, n = codes[~known], (1 << _WORD) - 1, self.codes.size
            while n + new.size > len(self.rows):
                self.rows = np.concatenate((self.rows, np.empty_like(self.rows)))
            for i, code in enumerate(new.tolist(), n):
                a, b, c = code >> 2 * _WORD, code >> _WORD & low, code & low
                self.rows[i] = self._turned(a, 2) * self._turned(b, 1) * self._turned(c, 0)
            codes_now = np.concatenate((self.codes, new))
            order = np.argsort(codes_now, kind="stable")
            self.codes = codes_now[order]
            self.at = np.concatenate((self.at, np.arange(n, n + new.size)))[order]
            place = np.searchsorted(self.codes, codes)
        return self.rows[self.at[place]]

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.zeros(self.dimensions)
        for i in range(0, codes.size, _NGRAMS_AT_A_TIME):
            part = slice(i, i + _NGRAMS_AT_A_TIME)
            total += counts[part].astype(np.float32) @ self.vectors(codes[part])
        return total


def learn(training: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototype of each language of ``training`` (text, lang), over all its rows.

    Rows with a null lang or without a letter add nothing.  Each task adds up the n-grams of its
    rows; only one vector for each task and language is shuffled.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, sums = Profiles(dimensions), {}
        for batch in batches:
            for part in slices(batch):
                held: dict[str, list] = {}
                langs = part.column("lang").to_pylist()
                for lang, text in zip(langs, part.column("text").to_pylist()):
                    held.setdefault(lang, []).append(profiles.ngrams(text))
                for lang, found in held.items():
                    codes, where = np.unique(
                        np.concatenate([x[0] for x in found]), return_inverse=True)
                    if codes.size:
                        counts = np.bincount(where, np.concatenate([x[1] for x in found]))
                        sums[lang] = sums.get(lang, 0) + profiles.bundle(codes, counts)
        yield pa.RecordBatch.from_arrays([
            pa.array(list(sums), pa.string()),
            pa.array([np.rint(x).astype(np.int64) for x in sums.values()], pa.list_(pa.int64())),
        ], ["lang", "total"])

    # The name of texts without a language is no language.
    totals = training.where(F.col("lang").isNotNull() & (F.col("lang") != UNDETERMINED)).select("text", "lang").mapInArrow(
        task, "lang string, total array<long>")
    values = totals.select("lang", F.posexplode("total").alias("i", "x")).groupBy("lang", "i").agg(
        F.sum("x").alias("x"))
    langs = values.groupBy("lang").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("x"))
    found = langs.limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return {r["lang"]: np.array(r["x"], np.float64) for r in sorted(found, key=lambda r: r["lang"])}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """(row, lang_pred, score) for each row of ``docs`` (row, text).

    score is the cosine with the chosen prototype, 0 if that is negative.  Texts that are null or
    have no letter get ``und`` and 0, as does every text if no language was learned.  Of equal
    cosines the first language by code point wins.  Repeated rows stay repeated.
    """
    langs = list(prototypes)
    dimensions = len(next(iter(prototypes.values()))) if prototypes else 1
    matrix = np.array([v / (np.linalg.norm(v) or 1) for v in prototypes.values()]).reshape(
        len(langs), dimensions)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(dimensions)
        for batch in batches:
            for part in slices(batch):
                names, scores = [], []
                for text in part.column("text").to_pylist():
                    codes, counts = profiles.ngrams(text) if langs else ((), ())
                    if not len(codes):
                        names.append(UNDETERMINED)
                        scores.append(0.0)
                        continue
                    whole = profiles.bundle(codes, counts)
                    cosines = matrix @ (whole / (np.linalg.norm(whole) or 1))
                    best = int(np.argmax(cosines))
                    names.append(langs[best])
                    scores.append(min(1.0, max(0.0, float(cosines[best]))))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(names, pa.string()),
                     pa.array(scores, pa.float64())], ["row", "lang_pred", "score"])

    kind = docs.schema["row"].dataType.simpleString()
    return docs.select("row", "text").mapInArrow(
        task, f"row {kind}, lang_pred string, score double")


def is_held_out(docs: DataFrame) -> DataFrame:
    """``held_out``: crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return docs.withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)))


def learn_from(docs: DataFrame) -> dict[str, np.ndarray]:
    """Prototypes from the documents that are not held out; rows with a null id are left out."""
    return learn(docs.select("doc_id", "text", "lang").where(remainder(F.col("doc_id"), 4) != 2))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows = is_held_out(docs).select(F.struct("doc_id", "held_out").alias("row"), "text")
    return predict(rows, learn_from(docs)).select("row.*", "lang_pred", "score")


def drop_undetermined(docs: DataFrame) -> DataFrame:
    """The documents with a language; those with a null text or without any letter go.

    Where no language can be learned, one stands for all: every text with a letter stays.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    learned = learn_from(docs) or {"any": np.ones(DIMENSIONS)}
    found = predict(rows, learned).where(F.col("lang_pred") != UNDETERMINED)
    return found.select("row.*")
