"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled texts give a logistic model that minimises the
non-negative unbiased risk: with prior p, positives' losses R+ (as positive) and R-
(as negative) and the unlabelled texts' loss Ru as negative, the risk is
``p * R+ + max(0, Ru - p * R-)``; where the second part is below zero a step is
taken against it, so the model can't win by overfitting.

The prior is estimated, not given: the share of unlabelled texts that score at
least t, over the same share of positives, bounds it from above at every t; the
least such bound with a margin of two standard errors is taken.

Texts that are null or empty get features of zero and a score like any other.
Repeated rows each get their result, equal texts equal scores.  A very long text is
read whole, in time and memory that grow with its length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from parley.llm.common import map_texts

NAMES = (
    "length", "letters", "wide", "upper", "digits", "space", "lines", "marks", "commas", "bars", "symbols", "other", "word_length", "distinct",
    "one_letter", "long_words", "bare", "shouted", "ends_in_symbol", "line_length", "line_copies", "line_ends", "said_again", "few_words", "empty",
)

_KIND = np.zeros(256, dtype=np.int64)
for _i in range(256):
    _c = chr(_i)
    _KIND[_i] = (
        1 if _i >= 128 else 2 if "A" <= _c <= "Z" else 0 if "a" <= _c <= "z" else 3 if _c.isdigit() else 5 if _c == "\n" else 4 if _c.isspace()
        else 6 if _c in ".!?" else 7 if _c in ",;:'\"()-" else 8 if _c in "|<>{}[]" else 9 if _c in "#$%&*@^~_=+\\/" else 10
    )


def features(text: str | None) -> list[float]:
    """The values of NAMES for the whole text."""
    if not text:
        return [0.0] * (len(NAMES) - 1) + [1.0]
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    counts = np.bincount(data, minlength=256)
    kinds = np.bincount(_KIND, weights=counts, minlength=11) / len(data)
    words = text.split()
    n = max(1, len(words))
    distinct = len(set(words))
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, dtype=np.int64)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    k = max(1, len(lines))
    again = sum(map(eq, words, words[1:])) / n
    symbol_ends = len(re.findall(r"[^\w\s.,;:!?'\")\]-](?=\s|$)", text))
    shouted = sum(map(str.isupper, words))
    return [
        float(np.log1p(len(data))), kinds[0], kinds[1], kinds[2], kinds[3], kinds[4], kinds[5] * 20, kinds[6] * 10, kinds[7] * 5, kinds[8] * 5, kinds[9] * 5,
        kinds[10] * 5, float(sizes.mean()) / 10, distinct / n, float((sizes == 1).sum()) / n, float((sizes > 20).sum()) / n,
        1.0 if kinds[6] == 0 else 0.0, shouted / n, symbol_ends / n, float(np.log1p(len(words) / k)) / 5, 1 - len(set(lines)) / k,
        sum(x.rstrip()[-1] in ".!?:\"'" for x in lines) / k, again * 10, 1.0 if len(words) < 12 else 0.0, 0.0,
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = expanded((np.asarray(x, dtype=float) - self.mean) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def expanded(x: np.ndarray) -> np.ndarray:
    """Features clipped to six deviations, and how far each is from its mean: bad texts may lie on either side."""
    x = np.clip(x, -6, 6)
    return np.hstack([x, np.abs(x)])


def prior_bound(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The least, over thresholds t, of the shares of unlabelled and of positive scores of t or more, with a margin."""
    n, m = len(positive), len(unlabelled)
    if not n or not m:
        return 0.5
    best = 1.0
    for t in np.quantile(positive, np.linspace(0.0, 0.8, 81)):
        p, u = (positive >= t).mean(), (unlabelled >= t).mean()
        margin = 2 * np.sqrt(p * (1 - p) / n) + 2 * np.sqrt(u * (1 - u) / m)
        if p > 4 * margin:
            best = min(best, (u + margin) / p)
    return float(np.clip(best, 0.05, 0.99))


def descend(p: np.ndarray, u: np.ndarray, prior: float, steps: int, rate: float, decay: float) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the non-negative risk with the logistic loss."""
    w, b = np.zeros(p.shape[1]), 0.0
    m, v = np.zeros(p.shape[1] + 1), np.zeros(p.shape[1] + 1)
    for t in range(1, steps + 1):
        sp, su = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) for x in (p, u))
        risk = (np.log1p(np.exp(np.clip(u @ w + b, -30, 30)))).mean() - prior * np.log1p(np.exp(np.clip(p @ w + b, -30, 30))).mean()
        as_positive = np.append(p.T @ (sp - 1), (sp - 1).sum()) / len(p)
        as_negative = np.append(u.T @ su, su.sum()) / len(u) - prior * np.append(p.T @ sp, sp.sum()) / len(p)
        g = prior * as_positive + as_negative if risk >= 0 else -as_negative
        g[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def fit(positive: list[str], unlabelled: list[str], steps: int = 600, rate: float = 0.03, decay: float = 1e-3) -> Model:
    """Estimate the prior with a first model (prior 1/2), then fit with it.  No positives or no unlabelled texts: a constant score."""
    p, u = (np.array([features(t) for t in x], dtype=float).reshape(len(x), len(NAMES)) for x in (positive, unlabelled))
    if not len(p) or not len(u):
        return Model(np.zeros(len(NAMES)), np.ones(len(NAMES)), np.zeros(2 * len(NAMES)), 0.0, 0.5)
    mean, scale = p.mean(axis=0), p.std(axis=0)
    scale = np.where(scale < 1e-3, 0.02, scale)
    p, u = expanded((p - mean) / scale), expanded((u - mean) / scale)
    first, bias = descend(p, u, 0.5, steps, rate, decay)
    prior = prior_bound(p @ first + bias, u @ first + bias)
    w, b = descend(p, u, prior, steps, rate, decay)
    return Model(mean, scale, w, float(b), prior)


def score(docs: DataFrame, text: Column, *ids: Column, model: Model) -> DataFrame:
    """(ids, score): the model's probability, 0 to 1, that each whole text is good."""
    added = T.StructType([T.StructField("score", T.DoubleType())])

    def make():
        def call(part: pa.RecordBatch) -> dict[str, list]:
            x = np.array([features(t) for t in part.column(part.num_columns - 1).to_pylist()])
            return {"score": model.score(x).tolist()}

        return call

    return map_texts(docs, [*ids, text.alias("_text")], make, added, len(ids))
