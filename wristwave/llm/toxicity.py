"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; a sample of all other text is unlabelled, toxic or not: which of
it is known to be clean is never read. With class prior p (given by the caller, such as the share of toxic rows
among labelled ones) the risk of a classifier f under the logistic loss is
p E_pos[l(f)] + max(0, E_unl[l(-f)] - p E_pos[l(-f)]); the second term is the corrected risk of the negatives.
Where it goes negative (the model has begun to memorise), the step is taken against it instead.

The model is linear over which words and word beginnings a text has, not how often, so one slur in a long
text weighs as in a short one. Features are those in whose presence toxicity is significantly likelier than not
(by the prior and the shares of positives and of unlabelled texts that have them). Training takes at most ``POSITIVES`` and
``UNLABELLED`` whole texts of any length (a hash of row and id decides which). Tasks turn them into feature
sets and Spark counts these; the driver gets the chosen features' names and, for each text, their numbers.
Scoring covers every whole text, one Arrow batch at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wristwave.llm.common import materialise, ship

#: Bounds of the training sample.
POSITIVES, UNLABELLED = 3000, 9000
#: A feature needs so many positives and so many standard errors; the most significant ``FEATURES`` are kept.
LEAST_TEXTS, SIGNIFICANT, FEATURES, STEPS = 4, 1.645, 60_000, 300
STEMS = (4, 5)


def features(text: str | None) -> set[str]:
    """Words in lower case without surrounding punctuation, and their first letters after a ^."""
    found = {w.strip(".,;:!?\"'()[]*#$%&|<>-_") for w in set((text or "").lower().split())}
    found.discard("")
    return found | {f"^{w[:n]}" for w in found for n in STEMS if len(w) > n}


class Model:
    """weights by feature, intercept."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: str | None) -> float:
        get = self.weights.get
        z = self.bias + sum(get(f, 0.0) for f in features(text))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def excess(among, rest, p: int, u: int, prior: float):
    """By how many standard errors toxicity is likelier than not in a text with the feature: prior * P(feature | toxic) against P(feature) / 2.

    Takes counts among p positives and u unlabelled texts as arrays or columns. Shares are shrunk by half a text, so
    that none is without an error.
    """
    a, r = (among + 0.5) / (p + 1), (rest + 0.5) / (u + 1)
    return (prior * a - r / 2) / (prior**2 * a * (1 - a) / p + r * (1 - r) / (4 * u)) ** 0.5


def train(positive: list[str], unlabelled: list[str], prior: float, steps: int = STEPS) -> Model:
    """``fit`` for texts at hand, in one process."""
    p, u = len(positive), len(unlabelled)
    if not p or not u:
        return descend([], [], p, u, prior, steps)
    sets = [features(t) for t in (*positive, *unlabelled)]
    among, rest = Counter(f for s in sets[:p] for f in s), Counter(f for s in sets[p:] for f in s)
    worth = {f: excess(n, rest[f], p, u, prior) for f, n in among.items() if n >= LEAST_TEXTS}
    kept = sorted(sorted((f for f, z in worth.items() if z > SIGNIFICANT), key=lambda f: (-worth[f], f))[:FEATURES])
    number = {f: i for i, f in enumerate(kept)}
    return descend(kept, [np.array([number[f] for f in s if f in number], dtype=np.int64) for s in sets], p, u, prior, steps)


def descend(kept: list[str], cols: list[np.ndarray], p: int, u: int, prior: float, steps: int = STEPS, l2: float = 3e-4, rate: float = 0.08) -> Model:
    """Full-batch Adam. ``cols``: each text's numbers in ``kept``, the p positives first.

    Without positives or unlabelled text the model says the prior for every text.
    """
    prior = min(max(prior, 1e-3), 0.5)
    start = float(np.log(prior / (1 - prior)))
    if not p or not u:
        return Model({}, start)
    row = np.repeat(np.arange(p + u), [len(c) for c in cols])
    col = np.concatenate([*cols, np.zeros(0, dtype=np.int64)]).astype(np.int64)
    n = p + u
    w, b = np.zeros(len(kept)), start
    m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        z = np.bincount(row, weights=w[col], minlength=n) + b
        s = sigmoid(z)
        soft = np.logaddexp(0, z)  # loss of calling a text negative
        negative = soft[p:].mean() - prior * soft[:p].mean()
        g = np.zeros(n)
        if negative >= 0:
            g[:p] = prior * (s[:p] - 1) / p - prior * s[:p] / p
            g[p:] = s[p:] / (n - p)
        else:  # the estimate is below what a risk can be: undo that part
            g[:p] = prior * s[:p] / p
            g[p:] = -s[p:] / (n - p)
        grad = np.append(np.bincount(col, weights=g[row], minlength=len(kept)) + l2 * prior * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = np.maximum(0, w - move[:-1]), b - move[-1]  # features are signs of toxicity, never excuses
    return Model({f: float(x) for f, x in zip(kept, w, strict=True) if abs(x) > 1e-4}, float(b))


def fit(docs: DataFrame, confirmed: DataFrame, prior: float, key: str = "doc_id", text: str = "text") -> Model:
    """``confirmed`` holds the keys of toxic training documents; the rest of ``docs`` is unlabelled.

    Texts count whole, whatever their length. Null and empty texts teach nothing and don't use up the sample; rows
    with a null key are unlabelled; rows equal in key and text count once, and where rows share a confirmed key each
    text is a positive. Ties of the hash go by the key. Other columns aren't read. Without positives or unlabelled
    text, as in empty tables, the model says the prior.
    """
    ship(docs.sparkSession)
    narrow = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.length("t") > 0).withColumn("h", F.xxhash64("k", "t"))
    marks = confirmed.select(F.col(key).alias("mk")).filter("mk is not null").distinct()
    rows = materialise(narrow.select("k", "h"), "toxicity-rows")  # texts stay where they are until the sample is drawn
    turn = F.col("h").bitwiseAND((1 << 40) - 1)

    def draw(some: DataFrame, most: int) -> DataFrame:
        """The ``most`` rows of smallest hash; all but about twice as many are dropped before any is sorted."""
        n = some.count()
        near = some if n <= 2 * most else some.filter(turn < int((1 << 40) * (2 * most + 1000) / n))
        return near.distinct().orderBy(turn, "h", "k").limit(most).select("h")

    toxic = materialise(rows.join(marks, rows["k"] == marks["mk"], "left_semi"), "toxicity-positives")
    n = rows.count()
    thin = rows if n <= 4 * UNLABELLED else rows.filter(turn < int((1 << 40) * (4 * UNLABELLED) / n))
    other = thin.join(marks, thin["k"] == marks["mk"], "left_anti")
    chosen = draw(toxic, POSITIVES).withColumn("y", F.lit(1)).unionByName(draw(other, UNLABELLED).withColumn("y", F.lit(0)))
    chosen = F.broadcast(materialise(chosen, "toxicity-chosen"))  # at most POSITIVES + UNLABELLED rows
    told = F.pandas_udf(lambda texts: texts.map(lambda t: sorted(features(t))), "array<string>")
    whole = narrow.join(chosen, "h").groupBy("h", "y").agg(F.first("t").alias("t"))
    sets = materialise(whole.select("h", "y", told("t").alias("fs")), "toxicity-features")
    p, u = (sets.filter(F.col("y") == y).count() for y in (1, 0))
    if not p or not u:
        return descend([], [], p, u, prior)
    each = sets.select("h", "y", F.explode("fs").alias("f"))
    seen = each.groupBy("f").agg(F.sum("y").alias("among"), F.sum(1 - F.col("y")).alias("rest")).filter(F.col("among") >= LEAST_TEXTS)
    worth = seen.select("f", excess(F.col("among"), F.col("rest"), p, u, prior).alias("z")).filter(F.col("z") > SIGNIFICANT)
    kept = sorted(r.f for r in worth.orderBy(F.desc("z"), "f").limit(FEATURES).collect())
    number = {f: i for i, f in enumerate(kept)}
    sent = docs.sparkSession.sparkContext.broadcast(number)  # at most FEATURES entries
    numbers = F.pandas_udf(lambda fs: fs.map(lambda s: [sent.value[f] for f in s if f in sent.value]), "array<int>")
    own = sorted(((1 - r.y, r.h), r.c) for r in sets.select("h", "y", numbers("fs").alias("c")).toLocalIterator())
    return descend(kept, [np.array(c, dtype=np.int64) for _, c in own], p, u, prior)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Every row and column of the table with its score; null and empty texts get the score of no evidence.

    Texts are scored whole, one Arrow batch of rows at a time; a very long text has to fit in a row. Equal texts get
    equal scores. A column that is already called ``out`` is replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast((model.weights, model.bias))  # at most FEATURES entries

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(*sent.value)
        for batch in texts:
            yield pd.Series([own.score(t) for t in batch], dtype="float64")

    return docs.withColumn(out, F.pandas_udf(run, "double")(F.col(text)))


