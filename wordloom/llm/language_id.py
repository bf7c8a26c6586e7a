"""Operator 6: language identification by string kernels.

The kernel of two texts is the number of character n-grams (n = 1 to ``ORDERS``, a blended spectrum, presence only) they
share, over the geometric mean of their numbers of n-grams. N-grams are taken from lower-cased letters, with each run of
other characters as one space, and hashed into ``BUCKETS``. ``landmarks`` training texts span the Nyström features
K(x, landmarks) K(landmarks, landmarks)^(-1/2), on which a ridge regression for each language against the rest is fitted.

Scores are linear in K(x, landmarks) = X L / sqrt(|x||l|), X and L being presence matrices of n-grams. So the product of L
and the regressions' weights is formed once, and a batch of texts is scored by multiplying its X with it.

Only a bounded sample is fitted: about ``per_language`` texts of each language, and ``landmarks`` of them. All texts are
scored whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm._common import short_batches

ORDERS = 4
BUCKETS = 1 << 18
UNDETERMINED = "und"
_LETTERS: list = []


def letter_table() -> np.ndarray:
    """Whether each code point is a letter; one table for each worker process."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def ngrams(text: str, seen: np.ndarray) -> np.ndarray | None:
    """Buckets of the text's n-grams, each once; None if it has no letter. seen: BUCKETS times False, as it is left."""
    code = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    letter = letter_table()[code]
    if not letter.any():
        return None
    code = np.where(letter, code, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of each run of others stays, as a space
    code = np.concatenate([[32], code[keep], [32]]).astype(np.uint32)
    with np.errstate(over="ignore"):
        gram = code
        for n in range(1, ORDERS + 1):
            if n > 1:
                if len(code) < n:
                    break
                gram = gram[:-1] * np.uint32(0x01000193) ^ code[n - 1 :] * np.uint32(0x85EBCA6B)
            h = gram * np.uint32(0x9E3779B1) + np.uint32(n * 0x7F4A7C15 & 0xFFFFFFFF)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            seen[h >> np.uint32(14)] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


class Model:
    def __init__(self, labels: list[str], weights: np.ndarray):
        self.labels, self.weights = labels, weights

    def values(self, texts: list[str | None]) -> tuple[list[int], np.ndarray]:
        """Which texts have a letter, and the values of the languages' regressions for them."""
        seen = np.zeros(BUCKETS, bool)
        grams = [None if t is None else ngrams(t, seen) for t in texts]
        at = [i for i, g in enumerate(grams) if g is not None]
        if not at or not self.labels:
            return [], np.zeros((0, len(self.labels)))
        size = np.asarray([len(grams[i]) for i in at])
        # X times the weights: the rows of the n-grams a text has, added up.
        flat = self.weights[np.concatenate([grams[i] for i in at])]
        return at, np.add.reduceat(flat, np.concatenate([[0], np.cumsum(size)[:-1]]), axis=0) / np.sqrt(size)[:, None]

    def claims(self, texts: list[str | None]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Which texts have a letter, the greatest value of each, and by how much it exceeds the next one (0, if there is one language)."""
        at, f = self.values(texts)
        own = np.sort(np.hstack([f, np.zeros((len(f), max(0, 2 - f.shape[1])))]), axis=1)
        return at, f.max(axis=1, initial=-np.inf), own[:, -1] - own[:, -2]

    def decide(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Label and score of each text."""
        out = [(UNDETERMINED, 0.0)] * len(texts)
        at, f = self.values(texts)
        if not at:
            return out
        # The targets are -1 and 1; a difference of 2 between languages is certain, one of 0 a tie.
        e = np.exp(4 * (f - f.max(axis=1, keepdims=True)))
        p = e / e.sum(axis=1, keepdims=True)
        best = f.argmax(axis=1)
        for k, i in enumerate(at):
            out[i] = (self.labels[best[k]], float(p[k, best[k]]))
        return out


def fit(texts: list[str], labels: list[str], landmarks: int, ridge: float) -> Model:
    """Kernel ridge regressions on Nyström features."""
    seen = np.zeros(BUCKETS, bool)
    grams = [ngrams(t, seen) for t in texts]
    data = [(g, l) for g, l in zip(grams, labels) if g is not None]
    names = sorted({l for _, l in data})
    if not names:
        return Model([], np.zeros((BUCKETS, 0), np.float32))
    grams, labels = [g for g, _ in data], np.asarray([names.index(l) for _, l in data])
    # Landmarks: the same number of each language, as far as there are.
    turn = np.empty(len(labels), np.int64)
    for k in range(len(names)):
        own = np.flatnonzero(labels == k)
        turn[own] = np.arange(len(own))
    chosen = np.lexsort((labels, turn))[:landmarks]

    used = np.unique(np.concatenate([grams[i] for i in chosen]))
    place = np.full(BUCKETS, -1)
    place[used] = np.arange(len(used))
    marks = np.zeros((len(used), len(chosen)), np.float32)
    for k, i in enumerate(chosen):
        marks[place[grams[i]], k] = 1 / np.sqrt(len(grams[i]))

    def kernel(rows: list[np.ndarray]) -> np.ndarray:
        out = np.empty((len(rows), len(chosen)), np.float64)
        for i in range(0, len(rows), 64):  # in batches, as dense matrices
            some = rows[i : i + 64]
            x = np.zeros((len(some), len(used)), np.float32)
            for k, g in enumerate(some):
                at = place[g]
                x[k, at[at >= 0]] = 1 / np.sqrt(len(g))
            out[i : i + 64] = x @ marks
        return out

    values, vectors = np.linalg.eigh(kernel([grams[i] for i in chosen]))
    root = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])
    phi = np.hstack([kernel(grams) @ root, np.full((len(grams), 1), 0.1)])
    y = np.where(labels[:, None] == np.arange(len(names)), 1.0, -1.0)
    # Each language weighs the same, however many texts it has.
    weight = (1 / np.bincount(labels, minlength=len(names)))[labels] * len(labels) / len(names)
    w = np.linalg.solve(phi.T @ (phi * weight[:, None]) + ridge * np.eye(phi.shape[1]), phi.T @ (y * weight[:, None]))
    out = np.zeros((BUCKETS, len(names)), np.float32)
    out[used] = marks @ (root @ w[:-1])
    return Model(names, out)


def remainder(doc_id, m: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % m


def fold(m: int):
    """crc32 of doc_id as text, modulo m; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(m))


def train(docs: DataFrame, folds: int = 5, held: int = 0, per_language: int = 500, landmarks: int = 320, ridge: float = 0.05, most_languages: int = 200, language_chars: int = 8 << 20) -> Model:
    """Fit on about per_language texts of each language, of the documents that aren't held out.

    Texts are drawn by a hash of doc_id and text, equal rows as one, and at most twice per_language of a language, or those before
    language_chars characters, are collected. More than most_languages languages are an error: the model has a column of weights for each.
    """
    rows = _drawn(docs, folds, held, per_language, most_languages, language_chars)
    return fit([r["text"] for r in rows], [r["lang"] for r in rows], landmarks, ridge)


def _drawn(docs: DataFrame, folds: int, held: int, per_language: int, most_languages: int, language_chars: int) -> list:
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    own = own.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(folds) != held))
    own = own.withColumn("draw", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "text", F.lit(17)), F.lit(1 << 40)))
    counts = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n")).limit(most_languages + 1).collect()}
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not counts:
        return []
    share = F.create_map(*(x for k, v in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, per_language / v)))))
    drawn = own.where(F.col("draw") < share[F.col("lang")] * float(1 << 40)).groupBy("lang", "draw").agg(F.first("text").alias("text"))
    by_draw = Window.partitionBy("lang").orderBy("draw")
    before = F.coalesce(F.sum(F.length("text")).over(by_draw.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    drawn = drawn.withColumns({"turn": F.row_number().over(by_draw), "before": before})
    rows = drawn.where((F.col("turn") <= 2 * per_language) & (F.col("before") < language_chars)).select("lang", "draw", "text").collect()
    return sorted(rows, key=lambda r: (r["lang"], r["draw"]))


#: A text that no language's regression gives more than this (the targets are -1 and 1) is claimed by none, if it is also as near to two of them
#: as texts of a language hardly ever are: the margin that ODD_SHARE of the UNSURE_SHARE least sure texts have, times SLACK.
UNCLAIMED, UNSURE_SHARE, ODD_SHARE, SLACK = 0.05, 0.1, 0.05, 0.25


def train_with_margin(docs: DataFrame, folds: int = 5, held: int = 0, per_language: int = 500, landmarks: int = 320, ridge: float = 0.05, most_languages: int = 200, language_chars: int = 8 << 20) -> tuple[Model, float]:
    """The model of :func:`train`, and a margin for :func:`claimed`, chosen on the fifth of the drawn texts that a second model, fitted on the others,
    hasn't seen."""
    rows = _drawn(docs, folds, held, per_language, most_languages, language_chars)
    rest = [r for r in rows if r["draw"] % 5]
    second = fit([r["text"] for r in rest], [r["lang"] for r in rest], landmarks, ridge)
    _, best, margin = second.claims([r["text"] for r in rows if r["draw"] % 5 == 0])
    unsure = margin[np.argsort(best)[: max(1, int(len(best) * UNSURE_SHARE))]]
    least = float(np.quantile(unsure, ODD_SHARE)) * SLACK if len(unsure) else 0.0
    return fit([r["text"] for r in rows], [r["lang"] for r in rows], landmarks, ridge), least


def claimed(docs: DataFrame, model: Model, least_margin: float) -> DataFrame:
    """The rows of ``docs`` whose text has a letter and is claimed by one of the model's languages (see UNCLAIMED). Whatever their names, all
    columns stay as they are. With a model of no language, all rows with a letter stay."""
    if not model.labels:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.labels, model.weights))  # BUCKETS rows, a column for each language

    @F.pandas_udf("boolean")
    def ours(texts: pd.Series) -> pd.Series:
        m, out = Model(*shared.value), np.zeros(len(texts), bool)
        for i in range(0, len(texts), 16):
            at, best, margin = m.claims([t if isinstance(t, str) else None for t in texts.iloc[i : i + 16]])
            out[[i + k for k in at]] = (best > UNCLAIMED) | (margin >= least_margin)
        return pd.Series(out)

    return docs.where(ours(F.col("text").cast("string")))


def _decided(model: Model, texts: pd.Series) -> pd.DataFrame:
    rows = []
    for i in range(0, len(texts), 16):
        rows += model.decide([t if isinstance(t, str) else None for t in texts.iloc[i : i + 16]])
    return pd.DataFrame(rows, columns=["lang_pred", "score"])


def identify(docs: DataFrame, model: Model, keep: bool = False) -> DataFrame:
    """doc_id, lang_pred, score of each row (or, with keep, all of docs, whose columns of the last two names are replaced): only texts are looked
    at.

    Null texts and those without a letter are ``und`` with score 0. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast((model.labels, model.weights))  # BUCKETS rows, a column for each language
    if keep:

        @F.pandas_udf("lang_pred string, score double")
        def found(texts: pd.Series) -> pd.DataFrame:
            return _decided(Model(*shared.value), texts)

        names = [c for c in docs.columns if c not in ("lang_pred", "score")]
        both = docs.select(*names, found(F.col("text").cast("string")).alias("lang_pred"))
        return both.select(*names, F.col("lang_pred.lang_pred").alias("lang_pred"), F.col("lang_pred.score").alias("score"))
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for batch in batches:
            found = []
            for i in range(0, batch.num_rows, 16):
                found += m.decide(batch.column(1).slice(i, 16).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], schema=schema)

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id bigint, lang_pred string, score double")
