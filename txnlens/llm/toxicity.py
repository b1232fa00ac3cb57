"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

A voter looks for the words of a lexicon, for a pattern, or for word stems that toxic labelled rows favour, and votes or
abstains. The label model sees only how often voters vote and vote together, counted over every document: under
independence the covariance of two voters is the product of their accuracies' strengths, so a rank-one fit gives the
accuracies, and the pairs it cannot explain are the correlated ones, which then share their evidence. Its posterior
labels at most ``max_rows`` sampled rows, on which a logistic regression over word and stem hits is trained.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.llm.common import held_out, text_of
from txnlens.llm.quality_classifier import labelled_sample
from txnlens.llm.textual import Runs, encoded, parts

LEXICONS = {
    "intellect": "idiot idiots moron morons stupid dumb imbecile fool dunce halfwit dimwit dumbass cretin brainless",
    "worth": "worthless useless pathetic loser losers failure",
    "disgust": "disgusting vile filthy repulsive nasty revolting sickening",
    "refuse": "trash garbage scum filth vermin parasite parasites maggot rubbish",
    "mockery": "clown clowns joke freak weirdo creep jerk buffoon lunatic psycho",
    "profanity": "shit fuck fucking bitch bastard asshole crap damn",
    "threat": "kill murder hurt destroy hate strangle",
    "german": "dummkopf trottel arschloch schwachkopf blödmann versager abschaum dreck",
    "french": "connard salaud imbécile abruti crétin merde ordure débile",
    "spanish": "idiota estúpido imbécil basura mierda cabrón inútil asqueroso",
}
STEMS = (4, 5, 6, 7)  # bytes of a word's beginning
STEM_VOTERS = 12
MIN_SHARE = 0.6  # lower bound of the toxic share among the labelled texts with a stem; the share itself is at least SHARE
SHARE = 0.9
MAX_STEMS = 4096
VOTERS = [*LEXICONS, "two_kinds", "three_hits", "dense", "addressed", "insult_mark", *[f"stems_{i}" for i in range(STEM_VOTERS)],
          "two_stems", "no_hit", "no_hit_long"]


def _hash(words: str) -> np.ndarray:
    runs = Runs([w.encode() for w in words.split()], lower=True)
    return np.unique(runs.hashes()[runs.first[:-1]])


LEXICON_HASHES = [_hash(words) for words in LEXICONS.values()]
ADDRESS = _hash("you your youre du ihr tu vous tú usted")
_NOTICED = np.unique(np.concatenate(LEXICON_HASHES))


def stems(texts: list[bytes]) -> tuple[Runs, list[tuple[np.ndarray, np.ndarray]]]:
    """The runs of the texts, and (runs, hashes) of whole words and of word beginnings of each length."""
    runs = Runs(texts, lower=True)
    word = np.flatnonzero(runs.kind == 1)
    out = [(word, runs.hashes(which=word))]
    for n in STEMS:
        longer = word[runs.end[word] - runs.start[word] > n]
        out.append((longer, runs.hashes(n, longer) ^ np.uint64(n)))
    return runs, out


def hits(texts: list[bytes], known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Votes (texts x voters, 0/1) and the (text, number in ``known``) pairs of the stems found."""
    votes = np.zeros((len(texts), len(VOTERS)), bool)
    found_text, found_stem = [], []
    for lo, hi in parts(texts):
        runs, got = stems(texts[lo:hi])
        n = hi - lo
        word, h = got[0]
        doc = runs.doc[word]
        insult = np.isin(h, _NOTICED)
        kinds = np.zeros(n, int)
        for j, lexicon in enumerate(LEXICON_HASHES):
            has = np.bincount(doc[insult], np.isin(h[insult], lexicon), n) > 0
            votes[lo:hi, j] = has
            kinds += has
        count, words = np.bincount(doc[insult], minlength=n), np.bincount(doc, minlength=n)
        near = np.zeros(n, bool)
        address = np.flatnonzero(np.isin(h, ADDRESS))
        for gap in (1, 2, 3):
            at = address[address + gap < len(h)]
            at = at[insult[at + gap] & (doc[at] == doc[at + gap])]
            near[doc[at]] = True
        mark = np.zeros(n, bool)
        after = word[insult] + 1
        ok = after < len(runs.start)
        bang = after[ok][runs.buf[runs.start[after[ok]]] == ord("!")]
        mark[runs.doc[bang]] = True
        stem_count = np.zeros(n, int)
        pairs = []
        if len(known):
            for which, hashes in got:
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                match = known[at] == hashes
                pairs.append(np.stack([runs.doc[which[match]], at[match]], axis=1))
            pairs = np.unique(np.concatenate(pairs), axis=0)
            for j in range(STEM_VOTERS):
                mine = pairs[pairs[:, 1] % STEM_VOTERS == j]
                votes[lo + mine[:, 0], len(LEXICONS) + 5 + j] = True
            stem_count = np.bincount(pairs[:, 0], minlength=n)
            found_text.append(lo + pairs[:, 0])
            found_stem.append(pairs[:, 1])
        none = (count == 0) & (stem_count == 0)
        five = np.stack([kinds >= 2, count >= 3, count * 100 > words, near, mark], axis=1)
        votes[lo:hi, len(LEXICONS):len(LEXICONS) + 5] = five
        votes[lo:hi, -3:] = np.stack([stem_count >= 2, none, none & (words >= 100)], axis=1)
    empty = np.zeros(0, int)
    return votes, np.concatenate(found_text or [empty]), np.concatenate(found_stem or [empty])


def _stem_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts, y = encoded(batch["text"]), batch["y"].to_numpy(int)
        for lo, hi in parts(texts):
            runs, got = stems(texts[lo:hi])
            pairs = np.unique(np.concatenate([np.stack([h, runs.doc[which].astype(np.uint64)], axis=1) for which, h in got]), axis=0)
            toxic = y[lo + pairs[:, 1].astype(int)]
            values, at = np.unique(pairs[:, 0], return_inverse=True)
            bad = np.bincount(at, toxic, len(values)).astype(np.int64)
            yield pd.DataFrame({"stem": values.view(np.int64), "bad": bad, "n": np.bincount(at, minlength=len(values))})


def toxic_stems(sample: DataFrame) -> np.ndarray:
    """Hashes of the stems whose texts in the labelled sample are toxic with a share surely above ``MIN_SHARE``."""
    counts = sample.mapInPandas(_stem_counts, "stem bigint, bad bigint, n bigint").groupBy("stem").agg(
        F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    p, n, z = F.col("bad") / F.col("n"), F.col("n"), 1.96
    lower = (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)  # Wilson's
    best = counts.where(f"bad >= 3 AND bad >= {SHARE} * n").withColumn("lower", lower).where(F.col("lower") >= MIN_SHARE)
    rows = best.orderBy(F.col("lower").desc(), "stem").limit(MAX_STEMS).select("stem").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


@dataclass
class LabelModel:
    """Per voter how often it votes on toxic and on clean texts, and how much of its evidence it shares."""

    prior: float
    if_toxic: np.ndarray
    if_clean: np.ndarray
    correlated: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        weight = 1 / (1 + self.correlated.sum(axis=1))
        yes, no = np.log(self.if_toxic / self.if_clean), np.log((1 - self.if_toxic) / (1 - self.if_clean))
        logit = np.log(self.prior / (1 - self.prior)) + np.where(votes, yes, no) @ weight
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit_label_model(n: int, first: np.ndarray, second: np.ndarray, prior: float, rounds: int = 50, spread: float = 3.0) -> LabelModel:
    """From the number of texts, the votes of each voter and those of each pair.

    Off the diagonal, cov = w w' with w = sqrt(prior (1 - prior)) (P(vote | toxic) - P(vote | clean)). Fitted by
    alternating least squares; pairs whose residual stands out are taken out as correlated, and the rest fitted again.
    """
    m = len(first)
    rate = first / max(n, 1)
    cov = second / max(n, 1) - np.outer(rate, rate)
    sd = np.sqrt(np.maximum(rate * (1 - rate), 1e-12))
    used = ~np.eye(m, dtype=bool) & (first > 0)[:, None] & (first > 0)[None, :]
    corr = np.where(used, cov / np.outer(sd, sd), 0)
    apart = np.zeros_like(used)
    for _ in range(3):
        keep = used & ~apart
        w = np.where(np.arange(m) < m - 2, 0.5, -0.5)  # the last two voters speak for clean texts
        for _ in range(rounds):
            for j in range(m):
                k = keep[j]
                down = (w[k] ** 2).sum()
                w[j] = np.clip((corr[j, k] * w[k]).sum() / down, -0.999, 0.999) if down > 1e-9 else 0.0
        residual = np.where(used, corr - np.outer(w, w), 0)
        scale = np.median(np.abs(residual[used])) if used.any() else 0
        apart = used & (residual > max(0.1, spread * scale))
    delta = w * sd / np.sqrt(prior * (1 - prior))
    toxic, clean = rate + (1 - prior) * delta, rate - prior * delta
    shared = np.where(apart, np.clip(residual, 0, 1), 0)
    return LabelModel(prior, np.clip(toxic, 1e-3, 1 - 1e-3), np.clip(clean, 1e-3, 1 - 1e-3), shared)


def _features(votes: np.ndarray, text: np.ndarray, stem: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: voters first, then stems."""
    t, v = np.nonzero(votes)
    return np.append(t, text), np.append(v, len(VOTERS) + stem), np.array([len(votes), len(VOTERS) + width])


def fit_linear(rows: np.ndarray, columns: np.ndarray, shape: np.ndarray, target: np.ndarray, decay: float = 3e-4, steps: int = 300) -> np.ndarray:
    """Weights and, last, the bias of a logistic regression on soft labels, by gradient steps with momentum."""
    n, d = shape
    w, speed = np.zeros(d + 1), np.zeros(d + 1)
    share = np.clip(target.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    w[-1] = np.log(share / (1 - share))
    for _ in range(steps if n else 0):
        logit = np.bincount(rows, w[columns], n) + w[-1]
        error = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - target
        slope = np.append(np.bincount(columns, error[rows], d) / n + decay * w[:-1], error.mean())
        speed = 0.9 * speed - 1.0 * slope
        w = w + speed
    return w


def score_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, cut: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``.

    Null and empty texts have no hits and score as such. Without labelled rows there are no stems, and the prior of
    toxic texts is one in ten. Rows that repeat score alike; an empty table gives no rows; other columns are ignored; a
    null id is not held out.
    """
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    sample = labelled_sample(docs, labels, "toxic", max_rows)
    known = toxic_stems(sample)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(VOTERS) + 1, len(VOTERS) + 1))
        for batch in batches:
            votes, _, _ = hits(encoded(batch["text"]), known)
            v = np.concatenate([votes, np.ones((len(votes), 1), bool)], axis=1).astype(float)
            total += v.T @ v
        yield pd.DataFrame({"cell": np.arange(total.size), "value": total.ravel().astype(np.int64)})

    got = base.select("text").mapInPandas(moments, "cell int, value bigint").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    total = np.zeros((len(VOTERS) + 1) ** 2)
    for cell, value in got:
        total[cell] = value
    total = total.reshape(len(VOTERS) + 1, -1)

    def sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            votes, text, stem = hits(encoded(batch["text"]), known)
            rows, columns, _ = _features(votes, text, stem, len(known))
            cut_at = np.searchsorted(np.sort(rows), np.arange(len(batch) + 1))
            order = np.argsort(rows, kind="stable")
            yield pd.DataFrame({"id": batch["doc_id"], "y": batch["y"], "columns": [columns[order[a:b]].astype(np.int32) for a, b in zip(cut_at, cut_at[1:])]})

    rows = sample.mapInPandas(sampled, "id bigint, y int, columns array<int>").toPandas().sort_values(["id", "y"], kind="stable")
    prior = (rows["y"].sum() + 0.5) / (len(rows) + 1) if len(rows) else 0.1
    model = fit_label_model(total[-1, -1], total[-1, :-1], total[:-1, :-1], float(np.clip(prior, 0.001, 0.5)))
    sizes = [len(c) for c in rows["columns"]]
    columns = np.concatenate([np.asarray(c) for c in rows["columns"]] or [np.zeros(0)]).astype(int)
    at = np.repeat(np.arange(len(rows)), sizes)
    votes = np.zeros((len(rows), len(VOTERS)), bool)
    votes[at[columns < len(VOTERS)], columns[columns < len(VOTERS)]] = True
    weights = fit_linear(at, columns, np.array([len(rows), len(VOTERS) + len(known)]), model.posterior(votes))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            votes, text, stem = hits(encoded(batch["text"]), known)
            r, c, _ = _features(votes, text, stem, len(known))
            logit = np.bincount(r, weights[c], len(batch)) + weights[-1]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": 1 / (1 + np.exp(-np.clip(logit, -30, 30)))})

    out = base.mapInPandas(score, "doc_id bigint, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
