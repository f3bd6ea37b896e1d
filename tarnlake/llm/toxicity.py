"""Toxicity as an ordered grade, by cumulative-link regression on words.

Labels only tell toxic from not. The grade of a labelled document is 0 if it isn't toxic; toxic ones
are graded 1 to GRADES by terciles of how often they use words that go with the label. The model has
one weight a feature, shared by all thresholds: P(grade >= k) = logistic(w . x - t_k), t_1 < t_2 < ...
Its features are the words, and beginnings of words, that go with the label beyond chance; others would
only add noise to long texts. Expected severity is the sum of the probabilities over k.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns

#: The training sample: labelled documents, and the most characters that these have. Bounds what the driver sees.
SAMPLE_DOCS, SAMPLE_CHARS = 6000, 20000
GRADES = 3
#: A word is a feature if that many standard errors away from chance, and used in so many sampled documents.
MIN_Z, MIN_DOCS = 5.0, 4
#: A document is toxic if P(grade >= 1) is at least this.
CUT = 0.5
#: Lengths of the beginnings of words that are features.
BEGINNINGS = (4, 5, 6, 7, 8)
WORD = re.compile(r"[^\W\d_]+")
RESULT = "severity double, p_toxic double, grade int, toxic boolean"


@dataclass
class Model:
    words: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray


def forms(word: str) -> list[str]:
    """A word as a feature, and its beginnings (marked by a hyphen)."""
    return [word, *[word[:n] + "-" for n in BEGINNINGS if n < len(word)]]


def features(text: str | None, words: dict[str, int]) -> dict[int, float]:
    """log(1 + count) of each known form of a whole text's words."""
    found: Counter = Counter()
    if text and words:
        for word, n in Counter(WORD.findall(text.lower())).items():
            for form in forms(word):
                if form in words:
                    found[words[form]] += n
    return {j: math.log1p(n) for j, n in found.items()}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def select_words(texts: list[str], toxic: np.ndarray) -> dict[str, int]:
    """The words and beginnings used by toxic documents more often than chance has it."""
    used, of_toxic = Counter(), Counter()
    for text, y in zip(texts, toxic):
        words = {form for word in set(WORD.findall(text.lower())) for form in forms(word)}
        used.update(words)
        if y:
            of_toxic.update(words)
    rate = toxic.mean() if len(toxic) else 0.0
    spread = rate * (1 - rate)
    kept = [w for w, n in used.items() if n >= MIN_DOCS and spread and (of_toxic[w] - n * rate) / np.sqrt(n * spread) >= MIN_Z]
    return {w: i for i, w in enumerate(sorted(kept))}


@dataclass
class Sparse:
    """A matrix of few entries: row, column and value of each."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    shape: tuple[int, int]

    @classmethod
    def of(cls, rows: list[dict[int, float]], columns: int) -> Sparse:
        sizes = [len(r) for r in rows]
        flat = [e for r in rows for e in r.items()]
        return cls(np.repeat(np.arange(len(rows)), sizes), np.array([j for j, _ in flat], np.int64), np.array([v for _, v in flat], float), (len(rows), columns))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.shape[0])

    def transposed_times(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * g[self.row], self.shape[1])


def loss(x: Sparse, grade: np.ndarray, params: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood with the penalty, and its gradient.

    params: a weight for each feature, the first threshold, and the logarithms of the gaps between thresholds.
    """
    n, d = x.shape
    w, gaps = params[:d], np.exp(params[d + 1 :])
    t = np.concatenate([[-np.inf], params[d] + np.concatenate([[0], np.cumsum(gaps)]), [np.inf]])
    score = x.times(w)
    # P(grade <= k) either side of the grade; the outermost are 1 and 0
    upper, lower = (np.where(np.isinf(edge), edge > 0, sigmoid(edge - score)) for edge in (t[grade + 1], t[grade]))
    p = np.maximum(upper - lower, 1e-12)
    du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
    of_t = (np.bincount(grade + 1, -du / n, GRADES + 2) + np.bincount(grade, dl / n, GRADES + 2))[1 : GRADES + 1]
    of_gaps = np.cumsum(of_t[::-1])[::-1][1:] * gaps  # a gap moves all thresholds above it
    value = -np.log(p).mean() + penalty / 2 * (w @ w)
    return value, np.concatenate([x.transposed_times((du - dl) / n) + penalty * w, [of_t.sum()], of_gaps])


def fit(x: Sparse, grade: np.ndarray, steps: int = 2000, penalty: float = 2e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of the cumulative-link model, by full-batch Adam over the sparse features."""
    d = x.shape[1]
    params = np.concatenate([np.zeros(d), [1.0], np.zeros(GRADES - 1)])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        _, grad = loss(x, grade, params, penalty)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return params[:d], params[d] + np.concatenate([[0], np.cumsum(np.exp(params[d + 1 :]))])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> Model:
    """The model of a bounded sample of labelled documents, the first by a hash of their id, with their whole texts.

    Documents of more than `chars` characters, unlabelled and NULL rows teach nothing. Of rows that repeat an
    id the least text counts, and it is toxic if any label says so. Without toxic or without clean rows the model
    knows no word and finds nothing toxic.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.max(label_col).alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)  # the bound of what is broadcast
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).filter(F.length("text") <= chars)
    got = rows.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text")).collect()
    got = sorted(((r["id"], r["text"], r["y"]) for r in got), key=lambda r: r[0])
    texts, toxic = [r[1] for r in got], np.array([r[2] for r in got], np.int64)
    words = select_words(texts, toxic)
    if not words:
        return Model({}, np.zeros(0), np.full(GRADES, np.inf))
    x = Sparse.of([features(text, words) for text in texts], len(words))
    use = np.bincount(x.row, x.value, len(texts))
    cuts = np.quantile(use[toxic == 1], np.arange(1, GRADES) / GRADES)
    grade = np.where(toxic == 1, 1 + np.searchsorted(cuts, use, side="left"), 0)
    return Model(words, *fit(x, grade))


def predict(df: DataFrame, model: Model, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """df with severity (0 to GRADES), p_toxic, grade (the likeliest) and toxic.

    NULL and empty texts are judged by the thresholds alone, as any text without known words. Of
    equally likely grades the lowest is named. Every text is read whole, however long. Repeated rows
    get equal answers; columns named like a result are replaced.
    """

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        found = [features(t, model.words) for t in batch.column(0).to_pylist()]
        scores = np.array([sum(model.weights[j] * v for j, v in f.items()) for f in found])
        at_least = sigmoid(scores[:, None] - model.thresholds[None, :]) if model.words and found else np.zeros((len(found), GRADES))
        ladder = np.concatenate([np.ones((len(found), 1)), at_least, np.zeros((len(found), 1))], axis=1)
        grade = (ladder[:, :-1] - ladder[:, 1:]).argmax(axis=1)
        return [pa.array(at_least.sum(axis=1), pa.float64()), pa.array(at_least[:, 0], pa.float64()), pa.array(grade, pa.int32()), pa.array(at_least[:, 0] >= cut, pa.bool_())]

    return add_columns(df, run, RESULT, [text_col], carry=False)
