"""Quality classifier: a linear support vector machine on n-gram indicators that are scaled by
naive Bayes log-count ratios, fitted by dual coordinate descent."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import pick
from tessella.llm.words import mix, plain, shapes, shingle_hashes, word_batches

FEATURE_BITS = 20
RUN_TEXTS = 512
#: Labelled documents (expected number, chosen by hash of the doc_id from all) that the model is fitted on.
TRAINING_ROWS = 8192
SMOOTHING, COST, EPOCHS = 1.0, 1.0, 20
#: Share of the fitted weights against their mean size.
INTERPOLATION = 0.25
THRESHOLD = 0.0
SEED = 5


def features(texts: list[str | None]):
    """Yield (index of the first text, texts, owner, feature): distinct hashed words, shapes of
    tokens, and pairs of neighbouring ones of each whole text, for runs of texts."""
    shift = np.uint64(64 - FEATURE_BITS)
    for i in range(0, len(texts), RUN_TEXTS):
        run = texts[i : i + RUN_TEXTS]
        keys = []
        for salt, prepare in enumerate((plain, shapes)):
            for first, words, counts in word_batches(run, prepare=prepare):
                for n in (1, 2):
                    hashed, sizes = shingle_hashes(mix(words + np.uint64(salt)), counts, n)
                    owner = first + np.repeat(np.arange(len(counts), dtype=np.uint64), sizes)
                    keys.append(owner << np.uint64(FEATURE_BITS) | hashed >> shift)
        key = np.unique(np.concatenate(keys))
        yield i, len(run), (key >> np.uint64(FEATURE_BITS)).astype(np.int64), (key & np.uint64((1 << FEATURE_BITS) - 1)).astype(np.int64)


def fit(rows: list[np.ndarray], labels: np.ndarray, smoothing: float = SMOOTHING, cost: float = COST, epochs: int = EPOCHS, interpolation: float = INTERPOLATION, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Weights by feature and a bias from feature lists and labels (0 or 1).  With one class only
    they are zero.  The hinge loss's dual is solved one coordinate at a time."""
    size = 1 << FEATURE_BITS
    y = np.where(labels > 0, 1.0, -1.0)
    if not len(y) or abs(y.sum()) == len(y):
        return np.zeros(size, dtype=np.float32), 0.0
    counts = {s: np.bincount(np.concatenate([r for r, v in zip(rows, y) if v == s]), minlength=size) + smoothing for s in (1.0, -1.0)}
    ratio = np.log(counts[1.0] / counts[1.0].sum()) - np.log(counts[-1.0] / counts[-1.0].sum())
    x = [ratio[r] for r in rows]
    scale = np.array([v @ v + 1.0 for v in x])
    share = {s: len(y) / (2.0 * (y == s).sum()) for s in (1.0, -1.0)}  # both classes weigh the same
    most = cost * np.array([share[s] for s in y])
    w, b, alpha = np.zeros(size), 0.0, np.zeros(len(y))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(y)):
            slope = y[i] * (w[rows[i]] @ x[i] + b) - 1.0
            new = min(max(alpha[i] - slope / scale[i], 0.0), most[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * x[i]
                b += step
                worst = max(worst, abs(step) * scale[i])
                alpha[i] = new
        if worst < 1e-3:
            break
    used = np.unique(np.concatenate(rows))
    mean = np.abs(w[used]).mean()
    return (((1 - interpolation) * mean + interpolation * w) * ratio).astype(np.float32), float(b) * interpolation


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAINING_ROWS) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of about ``rows`` labelled documents.  A doc_id with several labels has
    the most frequent one, and none if they are even; null ids, labels and texts don't count."""
    votes = labels.select(labels["doc_id"].alias("doc_id"), labels[label].cast("double").alias("y")).where("doc_id is not null and y is not null")
    voted = votes.groupBy("doc_id").agg(F.avg("y").alias("y")).where("y <> 0.5").select("doc_id", (F.col("y") > 0.5).cast("int").alias("y"))
    share = min(1.0, rows / max(1, voted.count()))
    bound = min((1 << 63) - 1, int(-(1 << 63) + share * (1 << 64)))
    drawn = voted.where(F.xxhash64("doc_id", F.lit(SEED)) <= F.lit(bound))

    def featured(batches):
        for batch in batches:
            for first, n, owner, feature in features(batch.column("text").to_pylist()):
                ends = np.searchsorted(owner, np.arange(n + 1))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, n), batch.column("y").slice(first, n), pa.array([feature[a:b].astype("<i4").tobytes() for a, b in zip(ends, ends[1:])], pa.binary())], ["doc_id", "y", "f"])

    chosen = pick(docs, "doc_id", "text").where("text is not null").join(F.broadcast(drawn), "doc_id")  # bounded by ``rows``
    found = sorted(chosen.select("doc_id", "text", "y").mapInArrow(featured, "doc_id long, y int, f binary").collect())
    return [np.frombuffer(r["f"], "<i4").astype(np.int64) for r in found], np.array([r["y"] for r in found], dtype=np.int64)


def classify(docs: DataFrame, weights: np.ndarray, bias: float, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, keep) of each row: its margin per square root of its features, and whether
    that reaches ``threshold``.  A text without words, a null one too, scores by the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2**FEATURE_BITS numbers, whatever the input

    def scored(batches):
        w = shared.value
        for batch in batches:
            for first, n, owner, feature in features(batch.column("text").to_pylist()):
                size = np.maximum(np.bincount(owner, minlength=n), 1)
                s = (np.bincount(owner, w[feature], n) + bias) / np.sqrt(size)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, n), pa.array(s), pa.array(s >= threshold)], ["doc_id", "score", "keep"])

    return pick(docs, "doc_id", "text").mapInArrow(scored, "doc_id long, score double, keep boolean")


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD, rows: int = TRAINING_ROWS) -> DataFrame:
    """Fit on labelled documents and classify all rows of ``docs`` (see ``classify``).

    Without labels of both classes the weights are zero and every row is kept.  Repeated rows
    get equal scores; an empty table gives no rows; other columns don't matter.
    """
    return classify(docs, *fit(*training_rows(docs, labels, label, rows)), threshold)
