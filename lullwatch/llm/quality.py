"""Quality classifier by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are labelled rows of quality 1. The unlabelled set is web text: documents drawn by a hash of doc_id, labelled or not; labels of quality 0 are never
looked at. The class prior is estimated from the two by the best bin: a first network ranks them on half of the rows; on the other half, the share of unlabelled over the share of
positive texts above a score is least where hardly any other class is left, and there it is the prior. A small network over text statistics minimises

    prior * E_P[loss(g, 1)] + max(0, E_U[loss(g, 0)] - prior * E_P[loss(g, 0)])

with the logistic loss; when the bracket turns negative, its gradient is reversed. Scores are the probabilities the network gives.

Fitting uses at most ``SAMPLE`` positives and ``SAMPLE`` unlabelled documents, chosen by a hash of doc_id among the rows that are not held out; scores cover all rows. Inputs are statistics
of the whole text only; labels, language, source and ids are never inputs.

Defined results: null and empty texts are scored like any text; without a positive label in the training rows every score is 0.5;
labels without a doc_id or quality are ignored; rows of a repeated doc_id are texts of their own; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lullwatch.llm.common import register, table, thrifty_map

SAMPLE = 20_000
"""Most positives, and most unlabelled documents, that the classifier is fitted on."""
THRESHOLD = 0.7

SYMBOLS = b"|!#*%&$.,:;-_/\\<>=+@~^(){}[]\"'?"


def statistics(text: str | None) -> np.ndarray:
    """Fixed-length statistics of a text: character classes, word shapes, repetition and lines."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digit, high = count[65:91].sum(), count[97:123].sum(), count[48:58].sum(), count[128:].sum()
    words = raw.split()
    m = max(1, len(words))
    seen = Counter(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    same = sum(map(bytes.__eq__, words[1:], words))
    pairs = len(set(zip(words, words[1:], strict=False))) / max(1, len(words) - 1)
    lines = raw.split(b"\n")
    shown = sum(c * c for c in seen.values()) / (m * m)
    heavy = sum(c for w, c in seen.items() if not w[-1:].isalnum() and w[-1] < 128 and not (w[-2:-1].isalnum() or w[-2:-1] >= b"\x80"))
    marked = sum(c for w, c in seen.items() if w[-1] < 128 and not w[-1:].isalnum() and w[-1:] not in b".,;:?")
    loud = sum(c for w, c in seen.items() if w.isupper())
    alone = sum(c for w, c in seen.items() if len(w) == 1 and not w.isalnum())
    rare = np.log1p(count[list(SYMBOLS)] / n * 100)
    return np.concatenate((
        [np.log1p(len(raw)), upper / n, lower / n, digit / n, high / n, (count[32] + count[9:14].sum()) / n, np.log1p(len(words)),
         size.mean(), size.std(), np.log1p(size.max()), len(seen) / m, len(seen) / m * np.log1p(m), same / m, pairs, np.log(shown + 1e-6), max(seen.values(), default=0) / m,
         heavy / m, marked / m, loud / m, alone / m, len(lines) / m, len(set(lines)) / len(lines), np.log1p(max(map(len, lines)))], rare))


class Network:
    """One hidden layer over standardised statistics."""

    def __init__(self, mean, scale, weights):
        self.mean, self.scale, self.weights = mean, scale, weights

    def margin(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.tanh(np.clip((x - self.mean) / self.scale, -6, 6) @ a + b) @ c + d

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, positive: np.ndarray, prior: float, hidden: int = 24, steps: int = 600, batch: int = 1024, rate: float = 0.01, decay: float = 1e-4,
        unlabelled: np.ndarray | None = None) -> Network:
    """Non-negative PU fit; ``x[positive]`` are the trusted positives, ``x[unlabelled]`` (all rows without it) the unlabelled set."""
    rng = np.random.default_rng(0)
    web = x if unlabelled is None else x[unlabelled]
    mean, scale = web.mean(axis=0), web.std(axis=0) + 1e-6
    p, z = np.clip((x[positive] - mean) / scale, -6, 6), np.clip((web - mean) / scale, -6, 6)
    w = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v = [np.zeros_like(k) for k in w], [np.zeros_like(k) for k in w]
    sigmoid = lambda g: 1 / (1 + np.exp(-np.clip(g, -30, 30)))
    for t in range(1, steps + 1):
        a, u = p[rng.integers(0, len(p), batch)], z[rng.integers(0, len(z), batch)]
        both = np.concatenate((a, u))
        h = np.tanh(both @ w[0] + w[1])
        s = sigmoid(h @ w[2] + w[3])
        sp, su = s[:batch], s[batch:]
        # negative class: E_U[-log(1-s)] - prior * E_P[-log(1-s)]
        negative = -np.log(1 - su + 1e-12).mean() + prior * np.log(1 - sp + 1e-12).mean()
        if negative >= 0:
            g = np.concatenate((prior * (sp - 1) - prior * sp, su)) / batch
        else:
            g = -np.concatenate((-prior * sp, su)) / batch
        back = np.outer(g, w[2]) * (1 - h * h)
        for k, grad in enumerate((both.T @ back, back.sum(axis=0), h.T @ g, np.array([g.sum()]))):
            grad = grad + decay * w[k]
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad * grad
            step = rate * min(1, 2 * (1 - t / (steps + 1)))
            w[k] -= step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Network(mean, scale, w)


def held_out(doc_id="doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2


def best_bin(good: np.ndarray, web: np.ndarray, delta: float = 0.1) -> float:
    """Class prior from scores of positives and of unlabelled texts: the least ratio of their shares above a score, where its upper bound is least."""
    cuts = np.sort(good)
    above = np.arange(len(good), 0, -1) / len(good)
    share = 1 - np.searchsorted(np.sort(web), cuts, "left") / len(web)
    slack = np.sqrt(np.log(4 / delta) / (2 * len(web))) + np.sqrt(np.log(4 / delta) / (2 * len(good)))
    k = int(np.argmin((share + slack) / above))
    return float(np.clip(share[k] / above[k], 0.01, 0.999))


def estimate_prior(x: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of the positive class in the unlabelled set; 0.5 where either half lacks a kind of rows."""
    half = np.arange(len(x)) % 2 == 0
    if min((mask & side).sum() for mask in (positive, unlabelled) for side in (half, ~half)) == 0:
        return 0.5
    net = fit(x[half], positive[half], 0.5, steps=300, unlabelled=unlabelled[half])
    return best_bin(net.margin(x[positive & ~half]), net.margin(x[unlabelled & ~half]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | None:
    """Network from the training rows; None without a positive among them."""
    drawn = lambda ids: ids.where("doc_id is not null").where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    good = drawn(labels.where("quality = 1").select("doc_id").distinct()).withColumn("good", F.lit(True))
    web = drawn(docs.select("doc_id")).distinct().withColumn("web", F.lit(True))
    chosen = good.join(web, "doc_id", "full").select("doc_id", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "web")])
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most two samples of ids

    def measure(batches):
        for b in batches:
            x = [statistics(t.as_py()).tolist() for t in b["text"]]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["good"], b["web"], pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "good", "web", "x"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    got = texts.select("doc_id", "text", "good", "web").mapInArrow(thrifty_map(measure), f"doc_id {kind}, good boolean, web boolean, x array<double>").toArrow().sort_by("doc_id")
    good, web = (np.array(got[c].to_pylist(), bool) for c in ("good", "web"))
    if not good.any() or not web.any():
        return None
    x = np.array(got["x"].to_pylist())
    return fit(x, good, estimate_prior(x, good, web), unlabelled=web)


def scored(docs: DataFrame, net: Network | None, keep: float | None = None) -> DataFrame:
    """``doc_id, score`` of every row; with ``keep``, the whole rows that score at least that much."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def judge(batches):
        for b in (b.slice(k, 1000) for b in batches for k in range(0, len(b), 1000)):
            s = np.full(len(b), 0.5)
            if sent.value is not None:
                s = sent.value.score(np.array([statistics(t.as_py()) for t in b["text"]]))
            if keep is None:
                yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(s)], names=["doc_id", "score"])
            else:
                yield b.filter(pa.array(s >= keep))

    if keep is not None:
        return docs.mapInArrow(thrifty_map(judge), docs.schema)
    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(thrifty_map(judge), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


@register("op4_quality")
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs, net).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
