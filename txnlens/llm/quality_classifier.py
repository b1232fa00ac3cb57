"""Quality classifier: random-indexing word vectors pooled per document, and a small calibrated network.

Every word form has a fixed sparse random index vector. The vector of a form is the sum of the index vectors of its
neighbours over the whole corpus, so forms that stand in like company come out alike. Forms are hashed to ``FORMS``
slots: the table of vectors has one size whatever the corpus, and counting it is a sum of integers by cell. A document
is the mean of its forms' vectors with the extremes over its passages; a two-layer network on that, fitted on at most
``max_rows`` labelled rows, gives the score, and a temperature fitted on rows left out of the fit calibrates it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.llm.common import held_out, text_of
from txnlens.llm.textual import Runs, encoded, mix, parts

FORMS = 1 << 14
DIM = 32
NONZERO = 4
REACH = 2  # neighbours on either side
PASSAGE = 40  # forms

_SEED = mix(np.arange(FORMS * NONZERO, dtype=np.uint64), 31).reshape(FORMS, NONZERO)
PLACES = (_SEED % np.uint64(DIM)).astype(np.int64)
SIGNS = np.where(_SEED >> np.uint64(63), 1, -1)


def forms(texts: list[bytes]) -> Runs:
    runs = Runs(texts)
    runs.form = (runs.hashes() % np.uint64(FORMS)).astype(np.int64)
    return runs


def _context_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of neighbours' index vectors: (cell, value) for the cells that are not zero."""
    total = np.zeros(FORMS * DIM, np.int64)
    for batch in batches:
        texts = encoded(batch["text"])
        for lo, hi in parts(texts):
            r = forms(texts[lo:hi])
            cells, values = [], []
            for gap in range(1, REACH + 1):
                near = r.doc[gap:] == r.doc[:-gap] if len(r.doc) > gap else np.zeros(0, bool)
                a, b = r.form[:-gap][near], r.form[gap:][near]
                for left, right in ((a, b), (b, a)):
                    cells.append((left[:, None] * DIM + PLACES[right]).ravel())
                    values.append(SIGNS[right].ravel())
            total += np.bincount(np.concatenate(cells), np.concatenate(values), FORMS * DIM).astype(np.int64)
    cell = np.flatnonzero(total)
    yield pd.DataFrame({"cell": cell.astype(np.int32), "value": total[cell]})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The vectors of all form slots, of unit length around their mean; counted over every document."""
    cells = docs.select(text_of(docs).alias("text")).mapInPandas(_context_counts, "cell int, value bigint")
    got = cells.groupBy("cell").agg(F.sum("value").alias("value")).toPandas()  # at most FORMS * DIM rows
    table = np.zeros(FORMS * DIM)
    table[got["cell"].to_numpy(int)] = got["value"]
    table = table.reshape(FORMS, DIM)
    size = np.linalg.norm(table, axis=1, keepdims=True)
    table = np.divide(table, size, out=np.zeros_like(table), where=size > 0)
    seen = size[:, 0] > 0
    return (table - (table[seen].mean(axis=0) if seen.any() else 0)).astype(np.float32)


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Per text the mean vector, and the least and greatest mean over passages; zeros for a text without forms."""
    out = np.zeros((len(texts), 3 * DIM), np.float32)
    for lo, hi in parts(texts):
        r = forms(texts[lo:hi])
        if not len(r.form):
            continue
        each = vectors[r.form]
        passage = (np.arange(len(r.form)) - np.repeat(r.first[:-1], r.counts)) // PASSAGE
        start = np.flatnonzero((np.diff(passage, prepend=-1) != 0) | (np.diff(r.doc, prepend=-1) != 0))
        size = np.diff(np.append(start, len(r.form)))[:, None]
        sums = np.add.reduceat(each, start)
        means, doc = sums / size, r.doc[start]
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        rows = lo + doc[first]
        out[rows, :DIM] = np.add.reduceat(sums, first) / r.counts[doc[first]][:, None]
        out[rows, DIM:2 * DIM] = np.minimum.reduceat(means, first)
        out[rows, 2 * DIM:] = np.maximum.reduceat(means, first)
    return out


@dataclass
class Network:
    """Standardised input, one hidden layer of rectifiers, a logit, and the temperature that divides it."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, batch: int = 128, decay: float = 1e-3) -> Network:
    """Adam on four fifths of the rows, temperature on the fifth left out. One class or no rows: a constant score."""
    rng = np.random.default_rng(7)
    d = x.shape[1]
    scale = x.std(axis=0) if len(x) else np.ones(d)
    net = Network(x.mean(axis=0) if len(x) else np.zeros(d), np.where(scale > 1e-6, scale, 1),
                  rng.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden), np.zeros(hidden), 0.0)
    share = (y.sum() + 1) / (len(y) + 2)
    net.b2 = float(np.log(share / (1 - share)))
    if len(set(y.tolist())) < 2:
        return net
    net.w2 = rng.normal(0, np.sqrt(1 / hidden), hidden)
    apart = rng.permutation(len(x)) % 5 == 0
    z, t = (x[~apart] - net.mean) / net.scale, y[~apart].astype(float)
    values = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, v = [np.zeros_like(p) for p in values], [np.zeros_like(p) for p in values]
    step = 0
    for epoch in range(epochs):
        rate = 3e-3 * (1 - epoch / epochs) + 1e-4
        for at in np.array_split(rng.permutation(len(z)), max(1, len(z) // batch)):
            h = np.maximum(z[at] @ values[0] + values[1], 0)
            error = (1 / (1 + np.exp(-np.clip(h @ values[2] + values[3][0], -30, 30))) - t[at]) / len(at)
            back = np.outer(error, values[2]) * (h > 0)
            slopes = [z[at].T @ back + decay * values[0], back.sum(axis=0), h.T @ error + decay * values[2], np.array([error.sum()])]
            step += 1
            for p, g, a, b in zip(values, slopes, m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = values[0], values[1], values[2], float(values[3][0])
    logits, truth = net.logits(x[apart]), y[apart]
    temperatures = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    losses = [np.mean(np.logaddexp(0, -np.clip(logits / t, -30, 30) * (2 * truth - 1))) for t in temperatures]
    net.temperature = float(temperatures[int(np.argmin(losses))])
    return net


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """``doc_id, text, y`` of at most ``max_rows`` labelled documents that are not held out, the same ones on every run.

    Labels that repeat count once. Of several texts with one id, the one of least hash counts.
    """
    chosen = labels.select(labels["doc_id"].alias("id"), labels[label].cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    chosen = chosen.where(~held_out(F.col("id"))).distinct().orderBy(F.xxhash64("id"), "id", "y").limit(max_rows)
    rows = docs.select(docs["doc_id"].alias("doc_id"), text_of(docs).alias("text")).join(
        F.broadcast(chosen), F.expr("doc_id = id"))  # at most max_rows pairs of numbers
    return rows.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("doc_id", "text", "y")


def score_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, cut: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``.

    Null and empty texts have zero vectors and the score that the network gives those. Without labelled rows of both
    classes every score is the same. Rows that repeat score alike, and an id is learnt from once; an empty table gives no
    rows; other columns are ignored; a null id is not held out.
    """
    vectors = word_vectors(docs)

    def vectorise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["doc_id"], "y": batch["y"], "x": list(pooled(encoded(batch["text"]), vectors))})

    sample = labelled_sample(docs, labels, "quality", max_rows).mapInPandas(vectorise, "id bigint, y int, x array<float>").toPandas()
    sample = sample.sort_values(["id", "y"], kind="stable")
    x = np.stack(sample["x"].to_list()) if len(sample) else np.zeros((0, 3 * DIM))
    network = fit_network(x.astype(float), sample["y"].to_numpy(int))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = network.scores(pooled(encoded(batch["text"]), vectors))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": values})

    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    out = base.mapInPandas(score, "doc_id bigint, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
