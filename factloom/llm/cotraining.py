"""Quality classification by co-training of a text-content view and a page-metadata view.

Each view is a naive Bayes model over discrete features, so a model is a table of counts. In every round both models
score all documents; where one is confident about a document without a label, the document counts, with that label,
for the other model. After the last round each view's score is calibrated on labelled documents held out from the
counts (Platt's sigmoid), a logistic combination of the two calibrated views is fitted on the same documents, and all
documents get its probability.

What is bounded: the vocabulary (the `words` words that tell the labels apart best) is chosen on at most `labelled`
labelled documents, of each class those with the smallest hashes: half of them, or more where the other class has less.
Without telling words, the other features are trained on. Everything else covers all documents: the pseudo-labels and counts
of every round, the calibration histograms and the scores. Metadata values are features by a hash into BUCKETS, so the
number of features is fixed, whatever the values; counts by feature and histograms of fixed size are all that reaches
the driver. The texts are read twice (vocabulary, features) and never shuffled; rounds read the feature table.

Labels are joined by key: labels of documents that aren't there are ignored, a document without a label, or with a null one, is unlabelled; several labels of one key
count as one by majority (ties: bad). Null texts are empty; null metadata is a value of its own. If either class has
no labelled document, everything is scored 1.0 (nothing is known against it). Repeated rows are scored alike; further
columns are ignored by `score` and kept by `accept`. The empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import durable, map_rows

WORD = re.compile(r"[^\W\d_]+").findall
#: Scores are kept within these bounds in histograms of BINS bins.
LIMIT, BINS = 12.0, 96
#: Features that the values of a metadata column fall into.
BUCKETS = 4096
FOLDS = 5


def _bin(x: float, edges: tuple[float, ...]) -> int:
    return sum(x >= e for e in edges)


#: Words from which on a text's shares and means are features.
SHORT = 12
#: A word tells the classes apart if its presence is so many times as frequent in one of them.
LIFT = 3.0
SHARES = (0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9)


def text_features(text: str, vocabulary: frozenset[str]) -> list[str]:
    """Features of the content: what words look like, how they repeat, which telling words occur."""
    tokens = text.split()
    n = max(1, len(tokens))
    letters = WORD(text)
    m = max(1, len(letters))
    distinct = set(letters)
    found = [
        f"marks:{_bin(sum(text.count(c) for c in '#$%&*!|') / n, SHARES)}",
        f"upper:{_bin(sum(w.isupper() and len(w) > 1 for w in letters) / m, SHARES)}",
        f"bars:{_bin(tokens.count('|') / n, SHARES)}",
        f"repeats:{_bin(sum(a == b for a, b in zip(letters, letters[1:], strict=False)) / m, SHARES)}",
    ]
    if n >= SHORT:  # of a few words these say little
        found += [
            f"ends:{_bin(sum(not t[-1].isalnum() for t in tokens) / n, SHARES)}",
            f"digits:{_bin(sum(map(str.isdigit, tokens)) / n, SHARES)}",
            f"distinct:{_bin(len(distinct) / math.sqrt(m), (0.5, 1, 2, 3, 4, 6, 8, 12))}",
            f"length:{_bin(sum(map(len, letters)) / m, (2, 3, 4, 5, 6, 7, 9, 12))}",
        ]
    return found + [f"word:{w}" for w in sorted({w.lower() for w in distinct} & vocabulary)]


def meta_features(values: tuple, text: str) -> list[str]:
    """Features of the page around the content: its metadata, size and layout."""
    lines = text.count("\n") + 1
    found = [f"m{i}:{'null' if v is None else crc32(str(v).encode('utf-8', 'replace')) % BUCKETS}" for i, v in enumerate(values)]
    return [*found, f"chars:{int(math.log2(len(text) + 1) * 2)}", f"lines:{int(math.log2(lines) * 2)}", f"line:{int(math.log2(len(text) / lines + 1))}"]


class Bayes:
    """Class-conditional counts of features, as log odds with add-one smoothing."""

    def __init__(self, counts: dict[tuple[str, int], float], totals: tuple[float, float]):
        bad, good = totals
        self.prior = math.log((good + 1) / (bad + 1))
        names = {f for f, _ in counts}
        self.odds = {f: math.log((counts.get((f, 1), 0) + 1) / (good + 2)) - math.log((counts.get((f, 0), 0) + 1) / (bad + 2)) for f in names}

    def __call__(self, features: list[str]) -> float:
        get = self.odds.get
        return max(-LIMIT, min(LIMIT, self.prior + sum([get(f, 0.0) for f in features])))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50, ridge: float = 1e-2) -> np.ndarray:
    """Weights, the constant last, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        slope = x.T @ (weight * (p - y)) + ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(curve, slope)
        w -= move
        if np.abs(move).max() < 1e-9:
            break
    return w


class Model:
    """Both views and how they combine."""

    def __init__(self, vocabulary: frozenset[str], text: Bayes, meta: Bayes, platt: tuple[np.ndarray, np.ndarray], joint: np.ndarray):
        self.vocabulary, self.text, self.meta = vocabulary, text, meta
        self.platt, self.joint = platt, joint

    def probability(self, text_score: float, meta_score: float) -> tuple[float, float, float]:
        """Calibrated probability of the text view, of the metadata view, and of both."""
        a = self.platt[0] @ (text_score, 1.0)
        b = self.platt[1] @ (meta_score, 1.0)
        return float(sigmoid(a)), float(sigmoid(b)), float(sigmoid(self.joint @ (a, b, 1.0)))

    def rate(self, text: str, values: tuple) -> tuple[float, float, float]:
        return self.probability(self.text(text_features(text, self.vocabulary)), self.meta(meta_features(values, text)))


def majority(labels: DataFrame, key: str, label: Column) -> DataFrame:
    """key, _y (0 bad, 1 good): one row for each key that has a label."""
    known = labels.select(F.col(key), label.cast("int").alias("_y")).filter(F.col(key).isNotNull() & F.col("_y").isNotNull())
    return known.groupBy(key).agg((F.avg("_y") > 0.5).cast("int").alias("_y"))


def choose_words(df: DataFrame, labels: DataFrame, key: str, text: str, labelled: int, words: int) -> frozenset[str]:
    """The words whose presence tells the classes apart best; labels: of documents of df."""
    trained = labels.filter(F.abs(F.xxhash64(key)) % FOLDS > 0)
    sizes = {r["_y"]: r["n"] for r in trained.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    # At most `labelled` rows of a key and a bit: small enough to broadcast by its own bound. Each class has half of
    # them, and what the other one leaves.
    parts = [trained.filter(F.col("_y") == y).orderBy(F.xxhash64(F.lit("sample"), key), key).limit(max(labelled // 2, labelled - sizes.get(1 - y, 0))) for y in (0, 1)]
    sample = parts[0].unionByName(parts[1])
    texts = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(F.broadcast(sample), key).select("_text", "_y")

    def rows(found: Iterator[tuple]) -> Iterator[tuple]:
        counts: Counter = Counter()
        for t, y in found:
            counts[None, y] += 1
            for w in {w.lower() for w in WORD(t)}:
                counts[w, y] += 1
            if len(counts) > 500_000:
                yield from ((w, y, n) for (w, y), n in counts.items())
                counts.clear()
        yield from ((w, y, n) for (w, y), n in counts.items())

    counts = map_rows(texts, rows, "word string, y int, n bigint").groupBy("word").agg(F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("good"))
    counts = durable(counts, "word-counts")
    total = counts.filter(F.col("word").isNull()).select("bad", "good").collect()
    bad, good = total[0] if total else (0, 0)
    if not bad or not good:
        return frozenset()
    # Difference of the presence rates in standard errors, for words with enough occurrences to tell.
    a, b = F.col("bad") / bad, F.col("good") / good
    pooled = (F.col("bad") + F.col("good")) / (bad + good)
    z = F.abs(a - b) / F.sqrt(pooled * (1 - pooled) * (1 / bad + 1 / good) + F.lit(1e-12))
    # Without the lift, frequent words would count: each says little, and together the same thing many times.
    lifted = (a >= LIFT * b) | (b >= LIFT * a)
    telling = counts.filter(F.col("word").isNotNull() & (F.col("bad") + F.col("good") >= 8) & lifted).withColumn("z", z).filter("z >= 4")
    return frozenset(r["word"] for r in telling.orderBy(F.desc("z"), "word").limit(words).collect())


def train(
    df: DataFrame,
    labels: DataFrame,
    label: Column,
    key: str = "doc_id",
    text: str = "text",
    metadata: tuple[str, ...] = ("lang", "source"),
    rounds: int = 3,
    confident: float = 0.98,
    labelled: int = 20_000,
    words: int = 256,
) -> tuple[Model | None, DataFrame]:
    """The model (None if a class has no label) and the feature table: key, _y, _fold, text and meta features."""
    known = durable(majority(labels, key, label).join(df.select(key), key, "left_semi"), "quality-labels")
    vocabulary = choose_words(df, known, key, text, labelled, words)
    width = len(metadata)

    def extract(found: Iterator[tuple]) -> Iterator[tuple]:
        for k, t, *values in found:
            yield k, text_features(t, vocabulary), meta_features(tuple(values), t)

    content = F.coalesce(F.col(text), F.lit("")).alias("_text")
    features = map_rows(df.select(F.col(key), content, *(F.col(m).cast("string") for m in metadata)), extract, f"{key} bigint, text_features array<string>, meta_features array<string>")
    assert width == len(metadata)
    fold = (F.abs(F.xxhash64(key)) % FOLDS).cast("int")
    features = durable(features.join(known, key, "left").withColumn("_fold", fold), "quality-features")
    if known.select("_y").distinct().count() < 2:
        return None, features
    views: tuple[Bayes, Bayes] | None = None
    certain = math.log(confident / (1 - confident))
    platt = (np.array([1.0, 0.0]), np.array([1.0, 0.0]))
    columns = features.select("text_features", "meta_features", "_y", "_fold")
    joint = np.array([1.0, 1.0, 0.0])
    for _ in range(rounds + 1):
        views = _count(columns, views, platt, certain)
        cells = _histogram(columns, *views)
        platt, joint = _calibrate(cells)
    assert views is not None
    return Model(vocabulary, *views, platt, joint), features


def _count(columns: DataFrame, views: tuple[Bayes, Bayes] | None, platt: tuple[np.ndarray, np.ndarray], certain: float) -> tuple[Bayes, Bayes]:
    """Both models from the labelled documents and from what each other's confident scores add."""

    def rows(found: Iterator[tuple]) -> Iterator[tuple]:
        counts: Counter = Counter()
        for text, meta, y, fold in found:
            given: list[int | None] = [None, None]
            if y is not None:
                if fold:
                    given = [y, y]
            elif views is not None:
                for i, (view, features) in enumerate(zip(views, (text, meta), strict=True)):
                    score = platt[i] @ (view(features), 1.0)
                    if abs(score) >= certain:
                        given[1 - i] = int(score > 0)
            for i, features in enumerate((text, meta)):
                if (label := given[i]) is not None:
                    counts[i, None, label] += 1
                    for f in features:
                        counts[i, f, label] += 1
        yield from ((*k, n) for k, n in counts.items())

    summed = map_rows(columns, rows, "view int, feature string, y int, n bigint").groupBy("view", "feature", "y").agg(F.sum("n").alias("n")).collect()
    models = []
    for i in (0, 1):
        totals = {r["y"]: r["n"] for r in summed if r["view"] == i and r["feature"] is None}
        models.append(Bayes({(r["feature"], r["y"]): r["n"] for r in summed if r["view"] == i and r["feature"] is not None}, (totals.get(0, 0), totals.get(1, 0))))
    return models[0], models[1]


def _histogram(columns: DataFrame, text_model: Bayes, meta_model: Bayes) -> list:
    """Held-out labelled documents by score bin of both views and label."""

    def rows(found: Iterator[tuple]) -> Iterator[tuple]:
        counts: Counter = Counter()
        for text, meta, y, _ in found:
            at = [min(BINS - 1, int((m(f) + LIMIT) / (2 * LIMIT) * BINS)) for m, f in ((text_model, text), (meta_model, meta))]
            counts[at[0], at[1], y] += 1
        yield from ((*k, n) for k, n in counts.items())

    held = columns.filter("_y is not null and _fold = 0")
    return map_rows(held, rows, "a int, b int, y int, n bigint").groupBy("a", "b", "y").agg(F.sum("n").alias("n")).collect()


def _calibrate(cells: list) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    if len({r["y"] for r in cells}) < 2:  # nothing to calibrate on: a class so rare that none of it was held out
        return (np.array([1.0, 0.0]), np.array([1.0, 0.0])), np.array([1.0, 1.0, 0.0])
    score = lambda i: (np.array([r[i] for r in cells]) + 0.5) / BINS * 2 * LIMIT - LIMIT
    y, n = np.array([r["y"] for r in cells], float), np.array([r["n"] for r in cells], float)
    a, b = score("a"), score("b")
    platt = fit_logistic(a[:, None], y, n), fit_logistic(b[:, None], y, n)
    both = np.column_stack([platt[0][0] * a + platt[0][1], platt[1][0] * b + platt[1][1]])
    return platt, fit_logistic(both, y, n)


def score(df: DataFrame, labels: DataFrame, label: Column, key: str = "doc_id", text: str = "text", metadata: tuple[str, ...] = ("lang", "source"), threshold: float = 0.5, **training) -> DataFrame:
    """key, text_score, meta_score, score (rounded to 6 places) and accepted for every row of df."""
    model, features = train(df, labels, label, key, text, metadata, **training)

    def rows(found: Iterator[tuple]) -> Iterator[tuple]:
        for k, t, m in found:
            p = (1.0, 1.0, 1.0) if model is None else model.probability(model.text(t), model.meta(m))
            yield k, *(round(x, 6) for x in p), p[2] >= threshold

    return map_rows(features.select(key, "text_features", "meta_features"), rows, f"{key} bigint, text_score double, meta_score double, score double, accepted boolean")


def accept(df: DataFrame, labels: DataFrame, label: Column, key: str = "doc_id", text: str = "text", metadata: tuple[str, ...] = ("lang", "source"), threshold: float = 0.5, **training) -> DataFrame:
    """df's rows, all columns, whose score reaches the threshold. Scores are taken where texts are read: no shuffle."""
    model, _ = train(df, labels, label, key, text, metadata, **training)
    if model is None:
        return df

    @F.pandas_udf("boolean")
    def good(frame):
        values = frame[list(metadata)].itertuples(index=False, name=None)
        return (frame["_text"].combine(list_of(values), lambda t, v: model.rate(t, v)[2] >= threshold)).astype(bool)

    content = F.coalesce(F.col(text), F.lit("")).alias("_text")
    return df.filter(good(F.struct(content, *(F.col(m).cast("string").alias(m) for m in metadata))))


def list_of(values):
    import pandas as pd

    return pd.Series(list(values), dtype=object)
