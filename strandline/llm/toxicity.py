"""Toxicity grades by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from strandline.llm.text import WordHashes, alnum_words, map_rows

BITS = 18
#: At most so many labelled rows are fitted, chosen by the hash of their id.
TRAIN_ROWS = 8000
#: A word counts in the fit if so many of the fitted rows have it.
LEAST_ROWS = 4
ITERATIONS, PENALTY, SHRINK = 300, 3.0, 1e-4


def features(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Which hashed words a text has, ascending."""
    return np.unique(hashes.of(alnum_words(text)) & np.uint64((1 << BITS) - 1)).astype(np.int32)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    """P(grade <= k) = sigmoid(thresholds[k] - score); the score shares one weight a word over all thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, at: np.ndarray) -> np.ndarray:
        below = _sigmoid(self.thresholds - float(self.weights[at].sum()))
        return np.diff(np.concatenate(([0.0], below, [1.0])))


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int) -> OrdinalModel:
    """Maximum likelihood with an L1 penalty by proximal full-batch steps; the same rows give the same model.

    Words are chosen under an L1 penalty, then refitted with a small L2 penalty alone, so that the choice doesn't
    shrink them.  A word's penalty is ``PENALTY`` times the deviation that its gradient would have if it told nothing of the grade.

    Without rows, every text gets grade 0.  A grade without rows leaves its threshold next to the one below.
    """
    weights = np.zeros(1 << BITS)
    counts = np.bincount(grades, minlength=n_grades) + 0.5
    share = np.cumsum(counts)[:-1] / counts.sum() if len(rows) else np.full(n_grades - 1, 1 - 1e-6)
    thresholds = np.log(share / (1 - share)) + 1e-3 * np.arange(n_grades - 1)
    if not rows:
        return OrdinalModel(weights, thresholds)
    lengths = np.array([len(r) for r in rows])
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), lengths)
    having = np.bincount(flat, minlength=1 << BITS)
    n = len(rows)
    some = (counts[1:].sum() / counts.sum()).item()
    words = np.flatnonzero(having >= LEAST_ROWS)
    w = np.zeros(len(words))
    for choosing in (True, False):
        if not choosing:  # what was not chosen keeps the weight zero
            words, w = words[w != 0], w[w != 0]
        place = np.full(1 << BITS, -1)
        place[words] = np.arange(len(words))
        known = place[flat] >= 0
        cells = _Cells(place[flat[known]], owner[known], len(words), n)
        penalty = PENALTY * np.sqrt(having[words] * some * (1 - some)) / n
        mean_w, seen_w, mean_t, seen_t = np.zeros(len(words)), np.zeros(len(words)), np.zeros(n_grades - 1), np.zeros(n_grades - 1)
        for k in range(1, ITERATIONS + 1):
            score = cells.by_row(w)
            upper = np.where(grades < n_grades - 1, _sigmoid(thresholds[np.minimum(grades, n_grades - 2)] - score), 1.0)
            lower = np.where(grades > 0, _sigmoid(thresholds[np.maximum(grades - 1, 0)] - score), 0.0)
            p = np.maximum(upper - lower, 1e-12)
            g_w = cells.by_word((1 - upper - lower) / n) + (0 if choosing else SHRINK * w)
            g_t = (
                np.bincount(np.maximum(grades - 1, 0), (grades > 0) * lower * (1 - lower) / p / n, n_grades)[: n_grades - 1]
                - np.bincount(grades, upper * (1 - upper) / p / n, n_grades)[: n_grades - 1]
            )
            mean_w, mean_t = 0.9 * mean_w + 0.1 * g_w, 0.9 * mean_t + 0.1 * g_t
            seen_w, seen_t = 0.99 * seen_w + 0.01 * g_w**2, 0.99 * seen_t + 0.01 * g_t**2
            rate = (0.02 if choosing else 0.05) / (1 - 0.9**k)
            step = rate / (np.sqrt(seen_w / (1 - 0.99**k)) + 1e-5)
            w = w - step * mean_w
            if choosing:
                w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
            thresholds = np.maximum.accumulate(thresholds - rate / (np.sqrt(seen_t / (1 - 0.99**k)) + 1e-5) * mean_t)
    weights[words] = w
    return OrdinalModel(weights, thresholds)


class _Cells:
    """The filled cells of a sparse matrix of rows and words, in both orders, so that sums run over consecutive ones."""

    def __init__(self, word: np.ndarray, row: np.ndarray, n_words: int, n_rows: int):
        self.sums = []
        for key, other, n in ((row, word, n_rows), (word, row, n_words)):
            order = np.argsort(key, kind="stable")
            filled, starts = np.unique(key[order], return_index=True)
            self.sums.append((other[order], filled, starts, n))

    def _sum(self, which: int, values: np.ndarray) -> np.ndarray:
        other, filled, starts, n = self.sums[which]
        out = np.zeros(n)
        if len(filled):
            out[filled] = np.add.reduceat(values[other], starts)
        return out

    def by_row(self, of_words: np.ndarray) -> np.ndarray:
        return self._sum(0, of_words)

    def by_word(self, of_rows: np.ndarray) -> np.ndarray:
        return self._sum(1, of_rows)


def severity_grade(toxic: str = "toxic", quality: str = "quality") -> Column:
    """Grades from the label columns: 0 good, 1 of low quality but not toxic, 2 toxic; null without a toxic label."""
    return F.when(F.col(toxic) == 1, 2).when((F.col(toxic) == 0) & (F.col(quality) == 0), 1).when(F.col(toxic) == 0, 0)


def fit_on(docs: DataFrame, grades: DataFrame, n_grades: int, train_rows: int = TRAIN_ROWS) -> OrdinalModel:
    """Fit on ``doc_id, grade`` rows (null grades dropped, the highest of repeated ids) and the texts of these ids.

    Of an id that several documents have the smallest text counts.
    """
    labelled = grades.where("grade IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("grade").alias("grade"))
    chosen = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    # One text an id, so that no more than train_rows rows are collected however often an id occurs.
    texts = docs.join(chosen, "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text")).select("doc_id", "text", "grade")

    def make():
        hashes = WordHashes()
        return lambda doc_id, text, grade: (doc_id, features(text, hashes).tobytes(), grade)

    id_type = texts.schema["doc_id"].dataType.simpleString()
    rows = map_rows(texts, make, f"doc_id {id_type}, words binary, grade int").collect()  # train_rows at most
    rows.sort(key=lambda r: (str(r.doc_id), r.words))
    return fit([np.frombuffer(r.words, np.int32) for r in rows], np.array([r.grade for r in rows], np.int64), n_grades)


def toxicity(docs: DataFrame, grades: DataFrame, n_grades: int = 3, toxic_grade: int = 2, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, expected_severity, p_toxic, grade, toxic`` of each row's whole text.

    ``grades`` has ``doc_id, grade`` (0 to n_grades - 1).  ``expected_severity`` is the mean grade under the model,
    ``p_toxic`` the probability of ``toxic_grade`` or worse, ``toxic`` whether that is a half or more and ``grade``
    the most likely grade given that verdict.  A null text has no words; repeated rows give repeated results; an empty
    table gives an empty frame; without labels nothing is toxic; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = fit_on(rows, grades.select("doc_id", F.col("grade").cast("int").alias("grade")), n_grades, train_rows)
    sent = rows.sparkSession.sparkContext.broadcast(model)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def make():
        hashes = WordHashes()

        def function(doc_id, text):
            p = sent.value.probabilities(features(text, hashes))
            bad = float(p[toxic_grade:].sum())
            grade = int(toxic_grade + np.argmax(p[toxic_grade:])) if bad >= 0.5 else int(np.argmax(p[:toxic_grade]))
            return doc_id, float(p @ np.arange(len(p))), bad, grade, bad >= 0.5

        return function

    return map_rows(rows, make, f"doc_id {id_type}, expected_severity double, p_toxic double, grade int, toxic boolean")
