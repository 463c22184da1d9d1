"""Operator 4: language identification with a string kernel.

A text is the set of its character n-grams of several lengths (a blended spectrum, presence only).
The kernel of two texts is the number of n-grams they share, divided by the geometric mean of
the set sizes. Nyström's method maps texts to a few coordinates by their kernels with landmark
texts; one ridge regression for each language, against the rest, is fitted in that space.
Texts are scored in batches by two matrix products.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import in_slices, row_keys, written

#: Texts of each language that are fitted, and of all languages (documented bounds of the training sample).
SAMPLE_PER_LANGUAGE, SAMPLE = 400, 16_000
#: Of them, landmarks of each language, and of all.
LANDMARKS_PER_LANGUAGE, LANDMARKS = 40, 1_600
#: Longer texts are scored in blocks of so many characters, since a very long one has nearly all n-grams of any language.
BLOCK = 8192
NGRAMS = (1, 2, 3)
#: Hashed n-grams fall into so many buckets; presence is a bit.
BUCKETS = 1 << 13
RIDGE = 1e-3
#: Scores are the logistic of regression values times this, normalised over the languages.
SHARPNESS = 8.0
UNKNOWN = "und"

has_letter = regex.compile(r"\p{L}").search


def blocks(text: str) -> list[str]:
    """The whole text in blocks of equal length up to BLOCK."""
    parts = -(-len(text) // BLOCK)
    return [text[len(text) * i // parts : len(text) * (i + 1) // parts] for i in range(parts)]


def presence(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Which hashed n-grams of the lower-cased text occur, one row of booleans."""
    out = np.zeros(buckets, bool)
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32).astype(np.uint64)
    mixed = np.zeros(len(points), np.uint64)
    for n in range(1, max(NGRAMS) + 1):
        if len(points) < n:
            break
        # The hash of the n-gram from each position: that of the (n-1)-gram and one more character.
        mixed = (mixed[: len(points) - n + 1] + points[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        if n in NGRAMS:
            out[(mixed >> np.uint64(7)) % np.uint64(buckets)] = True
    return out


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shared n-grams of all rows of a with all of b (0/1 as float32), normalised."""
    sizes = np.sqrt(np.maximum(a.sum(1), 1))[:, None] * np.sqrt(np.maximum(b.sum(1), 1))[None, :]
    return (a @ b.T) / sizes


@dataclass(frozen=True)
class LanguageModel:
    """A few hundred landmarks and one column of weights for each language: bounded."""

    languages: tuple[str, ...]
    landmarks: np.ndarray
    weights: np.ndarray
    constants: np.ndarray

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [i for i, t in enumerate(texts) if t and has_letter(t)]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if known and self.languages:
            values = np.zeros((len(known), len(self.languages)), np.float32)
            pieces = [(row, part) for row, i in enumerate(known) for part in blocks(texts[i]) if has_letter(part)]
            for i in range(0, len(pieces), 512):
                some = pieces[i : i + 512]
                x = np.stack([presence(part) for _, part in some]).astype(np.float32)
                np.add.at(values, [row for row, _ in some], kernel(x, self.landmarks) @ self.weights + self.constants)
            values /= np.bincount([row for row, _ in pieces], minlength=len(known))[:, None]
            chance = np.exp(SHARPNESS * (values - values.max(1, keepdims=True)))
            chance /= chance.sum(1, keepdims=True)
            best = chance.argmax(1)
            for row, i in enumerate(known):
                names[i], scores[i] = self.languages[best[row]], float(chance[row, best[row]])
        return names, scores


def solve(x: np.ndarray, languages: list[str]) -> LanguageModel:
    """Fit the model to rows of presence bits and their languages, in the given order."""
    names = tuple(sorted(set(languages)))
    labels = np.array(languages)
    each = max(1, min(LANDMARKS_PER_LANGUAGE, LANDMARKS // len(names)))
    chosen = np.concatenate([np.flatnonzero(labels == n)[:each] for n in names])
    landmarks = x[chosen]
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = kernel(x, landmarks).astype(np.float64) @ root
    z1 = np.hstack([z, np.ones((len(z), 1))])
    targets = np.where(labels[:, None] == np.array(names)[None, :], 1.0, -1.0)
    # Every language weighs the same, however many of its texts there are.
    weight = np.array([1.0 / np.count_nonzero(labels == label) for label in labels])
    gram = z1.T @ (z1 * weight[:, None]) + RIDGE * np.eye(z1.shape[1])
    fitted = np.linalg.solve(gram, z1.T @ (targets * weight[:, None]))
    return LanguageModel(names, landmarks, (root @ fitted[:-1]).astype(np.float32), fitted[-1].astype(np.float32))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """A model from a bounded sample of the labelled rows: for each language the
    SAMPLE_PER_LANGUAGE different rows (by id and text) whose hashes are smallest (fewer where languages are so many that these
    were more than SAMPLE), of a long text one of its blocks. Copies of a row count once. Rows without id, text with
    a letter, or language aren't used. What reaches the driver is 1 KB of presence bits for each
    sampled text. Without any usable row the model knows no language and answers `und`."""
    text = F.col(text_col).cast("string")
    known = df.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))
    known = known.select(*row_keys(id_col, text_col), F.col(lang_col).alias("tessera_lang")).distinct()
    # Of more than SAMPLE languages the most frequent are learned.
    counts = written(known.groupBy("tessera_lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tessera_lang").limit(SAMPLE), "languages")
    each = max(1, min(SAMPLE_PER_LANGUAGE, SAMPLE // max(1, counts.count())))
    # Hashes are spread evenly, so rows under this bound are a few more than are wanted: no task gets all of a language.
    bound = (2 * each + 50) / F.col("n")
    few = known.join(F.broadcast(counts), "tessera_lang").where((F.col("k1") / 2.0**64 + 0.5) < bound).drop("n")
    w = Window.partitionBy("tessera_lang").orderBy("k1", "k2")
    picked = few.withColumn("place", F.row_number().over(w)).where(F.col("place") <= each)
    # A bounded table: languages times the sample size; written once, for the join below.
    sample = written(picked.select(F.col("k1").alias("tessera_k1"), F.col("k2").alias("tessera_k2"), "tessera_lang"), "language-sample")

    def bits(rows: pa.RecordBatch) -> pa.RecordBatch:
        packed = []
        for k, text in zip(rows.column(0).to_pylist(), rows.column(2).to_pylist(), strict=True):
            parts = [part for part in blocks(text or "") if has_letter(part)]
            packed.append(np.packbits(presence(parts[k % len(parts)])).tobytes() if parts else None)
        return pa.record_batch([rows.column(0), rows.column(1), pa.array(packed, pa.binary())], ["k", "lang", "bits"])

    rows = df.select(*row_keys(id_col, text_col), text.alias("text"), F.col(lang_col).alias("lang"))
    few = rows.join(F.broadcast(sample), F.expr("k1 = tessera_k1 and k2 = tessera_k2 and lang = tessera_lang"), "left_semi")
    rows = few.select(F.col("k1").alias("k"), "lang", "text").mapInArrow(in_slices(bits), "k long, lang string, bits binary").dropDuplicates(["k", "lang"])
    got = sorted((r.lang, r.k, bytes(r.bits)) for r in rows.where("bits is not null").collect())
    if not got:
        return LanguageModel((), *(np.zeros((0, n), np.float32) for n in (BUCKETS, 0, 0)))
    x = np.stack([np.unpackbits(np.frombuffer(b, np.uint8)) for _, _, b in got]).astype(np.float32)
    return solve(x, [lang for lang, _, _ in got])


def predict(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for each row of df, from the whole text alone; no shuffle.

    `und` with score 0 for null texts, texts without a letter and models without languages; ties
    go to the language that sorts first. Repeated rows give repeated results, an empty table
    an empty one; other columns are left out.
    """

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = model.score(rows.column(1).to_pylist())
        return pa.record_batch([rows.column(0), pa.array(names), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    chosen = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(in_slices(run), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def predicted_language(text: Column, model: LanguageModel) -> Column:
    """struct(lang_pred, score) as a column beside the others of a row, for filters."""
    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        given = [t if isinstance(t, str) else None for t in texts]
        names, scores = [], []
        for i in range(0, len(given), 256):
            n, s = model.score(given[i : i + 256])
            names += n
            scores += s
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return run(text)


def held_out(id_col: str = "doc_id") -> Column:
    """Documents outside the training set: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0
