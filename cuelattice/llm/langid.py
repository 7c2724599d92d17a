"""Language ID: a byte convolutional network, trained in numpy on labelled text.

A text's bytes are cut into windows of fixed length, the last one padded. Filters of several widths slide over a
window; a filter of width w is a table (byte, filter) for each of its w offsets, so its value is a sum of w look-ups.
Max pooling over the window and ReLU give one feature per filter, and a softmax layer the languages' probabilities.
A document's probabilities are the mean over all of its windows.

Training: Adam on a bounded sample of labelled windows, at most PER_LANG per language, chosen by hash from all windows of all labelled
texts that are not held out. Prediction reads whole texts.

Defined cases: null texts and texts without a letter get `und` and score 0; with no labelled text at all every text
gets `und`; ties go to the language that comes first in order; a row without doc_id is not held out, and not learned from; rows that
repeat are learned from once and are each judged; very long texts are judged a few windows at a time; other columns, whatever their
names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelattice.llm.shared import bound_batches

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
#: Windows per language to train on at most.
PER_LANG = 3000
EPOCHS, BATCH, RATE, DECAY = 8, 128, 0.01, 1e-4
#: Symbol after a text's end; its table rows keep a filter from matching there.
PAD, OFF = 256, -1e4
UNKNOWN = "und"


class Net(NamedTuple):
    langs: list[str]
    #: One per width: (width, 257, FILTERS)
    tables: list[np.ndarray]
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: np.ndarray


def windows_of(data: bytes) -> np.ndarray:
    """All windows of a text, (n, WINDOW) of symbols."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.full(n * WINDOW, PAD, np.int16)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, WINDOW)


def _pooled(net: Net, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Features (n, all filters) and, per width, where each filter's maximum stands."""
    features, places = [], []
    for table, bias in zip(net.tables, net.biases, strict=True):
        w = len(table)
        span = x.shape[1] - w + 1
        total = np.take(table[0], x[:, :span], axis=0)
        for k in range(1, w):
            total += np.take(table[k], x[:, k : k + span], axis=0)
        at = total.argmax(1)
        places.append(at)
        features.append(np.take_along_axis(total, at[:, None], 1)[:, 0] + bias)
    return np.maximum(np.concatenate(features, 1), 0), places


def _best(net: Net, x: np.ndarray) -> np.ndarray:
    """Features alone, for prediction."""
    features = []
    for table, bias in zip(net.tables, net.biases, strict=True):
        w = len(table)
        span = x.shape[1] - w + 1
        total = np.take(table[0], x[:, :span], axis=0)
        for k in range(1, w):
            total += np.take(table[k], x[:, k : k + span], axis=0)
        features.append(total.max(1) + bias)
    return np.maximum(np.concatenate(features, 1), 0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def probabilities(net: Net, x: np.ndarray, step: int = 64) -> np.ndarray:
    """Per window; a few windows at a time, so that the filters' values stay in the cache."""
    return np.concatenate([_softmax(_best(net, x[i : i + step]) @ net.weights + net.bias) for i in range(0, len(x), step)])


def train(langs: list[str], x: np.ndarray, y: np.ndarray, seed: int = 1) -> Net:
    rng = np.random.default_rng(seed)
    f = np.float32
    net = Net(langs, [rng.normal(0, 0.3, (w, 257, FILTERS)).astype(f) for w in WIDTHS], [np.zeros(FILTERS, f) for _ in WIDTHS], rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(langs))).astype(f), np.zeros(len(langs), f))
    params = [*net.tables, *net.biases, net.weights, net.bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    share = len(y) / (len(langs) * np.maximum(1, np.bincount(y, minlength=len(langs))))
    n = 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for batch in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH)):
            n += 1
            xs, ys = x[batch], y[batch]
            for table in net.tables:
                table[:, PAD] = OFF
            h, places = _pooled(net, xs)
            d = _softmax(h @ net.weights + net.bias)
            d[np.arange(len(ys)), ys] -= 1
            d *= (share[ys] / len(ys))[:, None]
            back = (d @ net.weights.T) * (h > 0)
            grads, bias_grads = [], []
            for i, (table, at) in enumerate(zip(net.tables, places, strict=True)):
                own = back[:, i * FILTERS : (i + 1) * FILTERS]
                g = np.zeros_like(table)
                for k in range(len(table)):
                    rows = np.take_along_axis(xs, at + k, 1)
                    np.add.at(g[k], (rows, np.arange(FILTERS)[None]), own)
                g[:, PAD] = 0
                grads.append(g)
                bias_grads.append(own.sum(0))
            for p, g, m, v in zip(params, [*grads, *bias_grads, h.T @ d + DECAY * net.weights, d.sum(0)], first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.99**n)) + 1e-8)).astype(f)
    for table in net.tables:
        table[:, PAD] = OFF
    return net


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def sampled_windows(docs: DataFrame, per_lang: int = PER_LANG) -> list[tuple[str, bytes]]:
    """(lang, window) of the labelled documents that are not held out: of each language at most per_lang windows, those of least hash.
    Every window of every such text can be chosen; they are counted, hashed and cut on executors, and only the chosen ones reach the driver."""
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out())
    rows = rows.select("lang", F.encode("text", "UTF-8").alias("data"), F.xxhash64("doc_id", "text").alias("mark"))
    rows = rows.withColumn("last", F.floor((F.octet_length("data") - 1) / WINDOW).cast("int"))
    totals = rows.select("lang", "mark", "last").distinct().groupBy("lang").agg(F.sum(F.col("last") + 1).alias("n")).collect()  # one row per language
    if not totals:
        return []
    shares = docs.sparkSession.createDataFrame([(r.lang, min(1.0, 1.2 * per_lang / r.n)) for r in totals], "lang string, share double")
    place = lambda i: F.shiftrightunsigned(F.xxhash64("mark", i), 11) / float(1 << 53)
    chosen = F.filter(F.sequence(F.lit(0), "last"), lambda i: place(i) < F.col("share"))
    cut = F.transform(chosen, lambda i: F.struct(place(i).alias("place"), F.substr("data", i * WINDOW + 1, F.lit(WINDOW)).alias("window")))
    # One row per language, so its size is known. A row that repeats counts once.
    found = rows.join(F.broadcast(shares), "lang").select("lang", F.explode(cut).alias("w")).select("lang", "w.place", "w.window").distinct().collect()
    seen: Counter[str] = Counter()
    out = []
    for r in sorted(found):
        seen[r.lang] += 1
        if seen[r.lang] <= per_lang:
            out.append((r.lang, bytes(r.window)))
    return out


def fit(docs: DataFrame) -> Net | None:
    """Train on a sample of labelled windows; every fourth is shortened to a random length, as short texts are."""
    found = sampled_windows(docs)
    if not found:
        return None
    langs = sorted({lang for lang, _ in found})
    rng = np.random.default_rng(2)
    sizes = np.where(np.arange(len(found)) % 4, WINDOW, rng.integers(4, WINDOW, len(found)))
    x = np.concatenate([windows_of(w[:n]) for (_, w), n in zip(found, sizes.tolist(), strict=True)])
    return train(langs, x, np.array([langs.index(lang) for lang, _ in found]))


def judge(net: Net, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text; the windows of all texts go through the net together."""
    parts = [windows_of((t or "").encode()) for t in texts]
    p = probabilities(net, np.concatenate(parts))
    ends = np.cumsum([len(w) for w in parts])
    sums = np.add.reduceat(p, np.concatenate([[0], ends[:-1]]), axis=0)
    mean = sums / np.array([len(w) for w in parts])[:, None]
    best = mean.argmax(1)
    return [net.langs[i] for i in best], np.clip(mean[np.arange(len(best)), best], 0, 1).astype(float).tolist()


def with_language(docs: DataFrame, net: Net | None) -> DataFrame:
    """docs with a struct column `language` (lang_pred, score)."""
    bound_batches(docs.sparkSession)
    none = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    if net is None:
        return docs.withColumn("language", none)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(texts: pa.Array) -> pa.Array:
        lang, score = judge(shared.value, texts.to_pylist()) if len(texts) else ([], [])
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    found = F.arrow_udf(run, "lang_pred string, score double")(F.col("text"))
    return docs.withColumn("language", F.when(F.col("text").rlike(r"\p{L}"), found).otherwise(none))


def predicted(docs: DataFrame) -> DataFrame:
    net = fit(docs)
    return with_language(docs.select("doc_id", "text"), net).select("doc_id", held_out().alias("held_out"), "language.lang_pred", "language.score")
