"""Toxicity: subword-bag embeddings averaged into a linear softmax.

Training is plain numpy on the driver over a bounded sample of labelled
documents; embeddings and softmax weights are learnt jointly. A document is
judged by the worst of its passages, so that a few insults in a very long text
count as much as in a short one. A word that comes again within a passage's
length adds nothing to the average but its length, so one word said over and
over isn't taken for the passage's meaning. Because an average of embeddings followed by
a linear layer is linear, scoring multiplies the embeddings by the softmax
weights once and then only averages one number a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import _text as t
from pagewright.llm._subword import fresh, subwords, summed

SIZES, BITS, DIM = (3, 4, 5, 6), 18, 8
#: Words of a passage and the step from one to the next.
PASSAGE, STEP = 24, 8
#: A shorter text's average is taken over so many features, the missing ones like those of clean texts.
LEAST = 100
#: Labelled documents that training reads at most, as many toxic ones as clean.
TRAIN_DOCS = 3000
#: Models that are averaged, and shares of the labelled texts that each of them doesn't see.
FOLDS, LEFT_OUT = 6, 2
#: Share of errors by which a threshold may be worse than the best one.
NEARLY = 0.01


@dataclass
class Model:
    """``score[b]`` is bucket b's embedding times the softmax's weight difference."""

    score: np.ndarray
    bias: float
    threshold: float


def _marked(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and where each begins, after a newline: the first text's first word has its boundary mark like any other."""
    cps, at = t.code_points(texts)
    return np.concatenate([np.full(1, 10, cps.dtype), cps]), at + 1


def _bags(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text: buckets ordered by word, where each word's begin, and how many features went before it."""
    for text in texts:
        cps, _ = _marked(pa.array([text], type=pa.string()))
        ids, owner, starts, hashes = subwords(cps, SIZES, BITS)
        order = np.argsort(owner, kind="stable")
        ids, owner = ids[order], owner[order]
        size = np.bincount(owner, minlength=len(starts))
        new = fresh(hashes, np.zeros(len(hashes), np.int64), PASSAGE)
        zero = np.zeros(1, np.int64)
        yield ids[new[owner]], np.concatenate([zero, np.cumsum(size * new)]), np.concatenate([zero, np.cumsum(size)])


def _passages(n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last words of a text's passages; the last one ends with the text."""
    first = np.arange(0, max(n_words - PASSAGE, 0) + STEP, STEP)
    first = np.minimum(first, max(n_words - PASSAGE, 0))
    first = np.unique(first)
    return first, np.minimum(first + PASSAGE, n_words)


def _centred(emb: np.ndarray, out: np.ndarray, bias: np.ndarray, bags: list, clean: np.ndarray) -> tuple[np.ndarray, float]:
    """Scores and bias shifted so that a feature that isn't there counts as an average one of clean texts."""
    raw = emb @ (out[:, 1] - out[:, 0])
    means = [float(raw[bags[k][0]].mean()) for k in clean if len(bags[k][0])]
    mean = float(np.mean(means)) if means else 0.0
    return raw - np.float32(mean), float(bias[1] - bias[0]) + mean


def _worst(bag: tuple, small: np.ndarray, shift: float) -> tuple[int, float]:
    """The passage of a text that scores highest, and its score."""
    ids, w, a, b, c = bag
    if not len(ids):
        return 0, -np.inf
    v = np.concatenate([[0], np.cumsum(small[ids], dtype=np.float64)])
    s = (v[w[b]] - v[w[a]]) / np.maximum(c[b] - c[a], LEAST)
    return int(np.argmax(s)), float(s.max() + shift)


def _learn(bags: list, y: np.ndarray, use: np.ndarray, rng: np.random.Generator, rounds: int, rate: float) -> tuple[np.ndarray, float]:
    """Scores and bias learnt from the texts in ``use``.

    Each round takes the passage of each toxic text that the model so far
    holds the worst (at first: all its passages), against random and worst
    passages of the clean ones.
    """
    emb = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
    out = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    g_emb, g_out, g_bias = np.full(1 << BITS, 1e-3, np.float32), np.full((DIM, 2), 1e-3, np.float32), np.full(2, 1e-3, np.float32)
    clean = np.array([k for k in use if not y[k]])
    for r in range(rounds):
        small, shift = _centred(emb, out, bias, bags, clean)
        pick: list[tuple[int, int]] = []
        for k in use:
            ids, _, a, _, _ = bags[k]
            if not len(ids):
                continue
            if y[k] and r == 0:
                pick += [(k, int(j)) for j in rng.integers(0, len(a), min(len(a), 12))]
            elif y[k]:
                pick.append((k, _worst(bags[k], small, shift)[0]))
            else:
                pick += [(k, int(j)) for j in rng.integers(0, len(a), 3)]
                if r:
                    pick.append((k, _worst(bags[k], small, shift)[0]))
        label = np.array([y[k] for k, _ in pick])
        lo = np.array([bags[k][1][bags[k][2][j]] for k, j in pick])
        ln = np.array([bags[k][1][bags[k][3][j]] for k, j in pick]) - lo
        full = np.array([bags[k][4][bags[k][3][j]] - bags[k][4][bags[k][2][j]] for k, j in pick])
        weight = np.where(label == 1, 0.5 / max(label.sum(), 1), 0.5 / max((label == 0).sum(), 1)) * len(label)
        for _ in range(4):
            order = rng.permutation(len(pick))
            for at in range(0, len(order), 256):
                some = order[at : at + 256]
                some = some[ln[some] > 0]
                if not len(some):
                    continue
                ids = np.concatenate([bags[pick[i][0]][0][lo[i] : lo[i] + ln[i]] for i in some])
                size = ln[some]
                cut = np.concatenate([[0], np.cumsum(size)[:-1]])
                h = np.add.reduceat(emb[ids], cut, axis=0) / np.maximum(full[some], LEAST)[:, None]
                z = h @ out + bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                d = (p - np.eye(2, dtype=np.float32)[label[some]]) * (weight[some] / len(some))[:, None]
                d = d.astype(np.float32)
                by_id = np.argsort(ids, kind="stable")
                ranked = ids[by_id]
                start = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
                uniq, times = ranked[start], np.diff(np.concatenate([start, [len(ids)]]))
                into = (d @ out.T) * (len(some) / 16)
                g = np.add.reduceat(into[np.repeat(np.arange(len(some)), size)[by_id]], start, axis=0) / np.sqrt(times).astype(np.float32)[:, None]
                g_emb[uniq] += (g**2).mean(axis=1)
                emb[uniq] -= rate * g / np.sqrt(g_emb[uniq])[:, None]
                go = h.T @ d
                g_out += go**2
                out -= rate * go / np.sqrt(g_out)
                gb = d.sum(axis=0)
                g_bias += gb**2
                bias -= 0.1 * rate * gb / np.sqrt(g_bias)
    return _centred(emb, out, bias, bags, clean)


def train(texts: list[str], toxic: list[int], seed: int = 7, rounds: int = 4, rate: float = 0.3, folds: int = FOLDS) -> Model:
    """Fit on labelled texts; with one class only, nothing is ever called toxic.

    The texts are dealt into ``folds`` shares, class by class, and as many
    models are learnt, each without ``LEFT_OUT`` shares. What stays is the mean
    of the models, which is linear like each of them; the threshold comes from
    the scores that the mean of the models that didn't see a text gives it.
    """
    y = np.asarray(toxic, dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << BITS, np.float32), 0.0, np.inf)
    rng = np.random.default_rng(seed)
    bags = [(i, w, *_passages(len(w) - 1), c) for i, w, c in _bags(texts)]
    fold = np.zeros(len(y), np.int64)
    for c in (0, 1):
        mine = rng.permutation(np.flatnonzero(y == c))
        fold[mine] = np.arange(len(mine)) % folds
    models = []
    for f in range(folds):
        use = np.flatnonzero((fold - f) % folds >= LEFT_OUT)
        if len(np.unique(y[use])) < 2:  # a class of very few texts is in every model
            use = np.arange(len(y))
        models.append(_learn(bags, y, use, rng, rounds, rate))
    small, shift = sum(m for m, _ in models) / folds, sum(b for _, b in models) / folds
    s = np.zeros(len(y))
    for f in range(folds):
        unseen = [models[(f - i) % folds] for i in range(LEFT_OUT)]
        own, bias = sum(m for m, _ in unseen) / LEFT_OUT, sum(b for _, b in unseen) / LEFT_OUT
        for k in np.flatnonzero(fold == f):
            s[k] = _worst(bags[k], own, bias)[1]
    bad, good = np.sort(s[y == 1]), np.sort(s[y == 0])
    cuts = np.concatenate([bad, good])
    cuts = np.sort(cuts[np.isfinite(cuts)])
    cuts = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts
    wrong = np.searchsorted(bad, cuts) / len(bad) + (len(good) - np.searchsorted(good, cuts)) / len(good)
    # of thresholds about as good, the lowest: a miss costs more, and the mean of all models errs less than those it is judged by
    best = cuts[wrong <= wrong.min() + NEARLY]
    return Model(small.astype(np.float32), shift, float(best[0]))


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, seed: int = 7) -> Model:
    """Train on labelled documents, ``most`` of them at most.

    Half the bound goes to each class, in the order of a hash of doc_id, so
    the sample is the same wherever and however the tables are stored. Rows
    without an id, a text or a 0/1 label are not used; of several labels for
    one document the highest counts.
    """
    known = labels.select("doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if known.schema["doc_id"].dataType != docs.schema["doc_id"].dataType:
        known = known.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
    picks = known.withColumn("_at", F.xxhash64(F.lit(seed), "doc_id"))
    chosen = picks.where("toxic = 1").orderBy("_at", "doc_id").limit(most // 2).unionByName(picks.where("toxic = 0").orderBy("_at", "doc_id").limit(most - most // 2))
    ids = [(r["doc_id"], r["toxic"]) for r in chosen.select("doc_id", "toxic").collect()]
    if not ids:
        return train([], [])
    small = F.broadcast(docs.sparkSession.createDataFrame(ids, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, toxic int"))  # at most ``most`` rows
    rows = docs.select("doc_id", "text").where("text is not null").join(small, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    model = train([r["text"] for r in rows], [r["toxic"] for r in rows], seed)
    t.tidy()  # the driver goes on to other stages
    return model


def score_batch(texts: pa.Array, model: Model) -> np.ndarray:
    """The worst passage's log odds of each text; -inf where there is no word."""
    cps, at = _marked(texts)
    sums, counts, starts, hashes = summed(cps, model.score, SIZES, BITS)
    begin = np.searchsorted(starts, at[:-1])
    end = np.searchsorted(starts, at[1:])
    text = np.repeat(np.arange(len(texts)), end - begin)
    sums = np.concatenate([[0], np.cumsum(sums * fresh(hashes, text, PASSAGE))])
    counts = np.concatenate([[0], np.cumsum(counts)])
    result = np.full(len(texts), -np.inf)
    full = np.flatnonzero(end > begin)
    last = np.maximum(end[full] - begin[full] - PASSAGE, 0)
    number = (last + STEP - 1) // STEP + 1
    first = np.cumsum(number) - number
    step = np.arange(int(number.sum())) - np.repeat(first, number)
    a = np.repeat(begin[full], number) + np.minimum(step * STEP, np.repeat(last, number))
    b = np.minimum(a + PASSAGE, np.repeat(end[full], number))
    if len(full):
        result[full] = np.maximum.reduceat((sums[b] - sums[a]) / np.maximum(counts[b] - counts[a], LEAST), first) + model.bias
    return result


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, toxic_score, toxic`` for every row of documents.

    The score is the probability that the softmax gives the worst passage;
    a null, empty or wordless text has score 0 and is not toxic. Repeated rows
    and null ids are judged like any other row. No other column is read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in t.slices(batch, "text"):
                s = score_batch(part.column("text"), shared.value)
                with np.errstate(over="ignore"):
                    p = 1 / (1 + np.exp(-s))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p), pa.array(s > shared.value.threshold)], ["doc_id", "toxic_score", "toxic"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, toxic_score double, toxic boolean")


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The rows, all columns, whose text is not toxic; null texts stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in t.slices(batch, "text"):
                yield part.filter(pa.array(~(score_batch(part.column("text"), shared.value) > shared.value.threshold)))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its toxicity score and the decision."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
