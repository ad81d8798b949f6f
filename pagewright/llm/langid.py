"""Language ID: the family first, then one-versus-one linear SVMs inside it.

Every classifier is linear in the relative frequencies of character n-grams,
so a batch of texts is judged by summing one table row an n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import _text as t
from pagewright.llm._subword import subwords, summed

SIZES, BITS = (1, 2, 3), 13
#: Labelled documents of each language that training reads at most, and of all together.
TRAIN_EACH, TRAIN_ALL = 400, 8000
#: Languages that are closely related; a language not named is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "bg", "sr"),
}
UNKNOWN = "und"


@dataclass
class Model:
    """Columns of ``table``: one a family, then one a pair of languages of one family."""

    table: np.ndarray
    bias: np.ndarray
    families: list[str]
    pairs: list[tuple[str, str]]
    members: dict[str, list[str]]


def _family(lang: str) -> str:
    return next((f for f, ls in FAMILIES.items() if lang in ls), lang)


def _svm(x: np.ndarray, y: np.ndarray, decay: float = 1e-3, steps: int = 300) -> tuple[np.ndarray, float]:
    """Squared hinge loss with classes weighted alike, by gradient steps with momentum; y is +1 or -1."""
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    top = 2 * (weight @ (x**2).sum(axis=1)) + 2 + decay
    w, b = np.zeros(x.shape[1]), 0.0
    vw, vb = w, b
    for i in range(steps):
        gap = np.maximum(0, 1 - y * (x @ vw + vb)) * y * weight * 2
        nw, nb = vw - (decay * vw - x.T @ gap) / top, vb + gap.sum() / top
        m = i / (i + 3)
        vw, vb, w, b = nw + m * (nw - w), nb + m * (nb - b), nw, nb
    return w, b


def train(texts: list[str], langs: list[str]) -> Model:
    """Fit on labelled texts; a family of one language has no pairs."""
    found = sorted(set(langs))
    families = sorted({_family(x) for x in found})
    members = {f: [x for x in found if _family(x) == f] for f in families}
    pairs = [p for f in families for p in combinations(members[f], 2)]
    x = np.zeros((len(texts), 1 << BITS))
    for i, text in enumerate(texts):
        ids, *_ = subwords(t.code_points(pa.array([text]))[0], SIZES, BITS)
        x[i] = np.bincount(ids, minlength=1 << BITS) / max(len(ids), 1)
    scale = 1 / np.sqrt(x.mean(axis=0) + 1e-4) if len(texts) else np.ones(1 << BITS)
    x *= scale
    lang = np.array(langs, dtype=object)
    fam = np.array([_family(v) for v in langs], dtype=object)
    columns, bias = [], []
    for f in families:
        w, b = _svm(x, np.where(fam == f, 1.0, -1.0)) if len(families) > 1 else (np.zeros(1 << BITS), 0.0)
        columns.append(w * scale)
        bias.append(b)
    for one, two in pairs:
        some = (lang == one) | (lang == two)
        w, b = _svm(x[some], np.where(lang[some] == one, 1.0, -1.0))
        columns.append(w * scale)
        bias.append(b)
    table = np.stack(columns, axis=1).astype(np.float32) if columns else np.zeros((1 << BITS, 0), np.float32)
    return Model(table, np.array(bias), families, pairs, members)


def fit(docs: DataFrame, each: int = TRAIN_EACH, everything: int = TRAIN_ALL, seed: int = 11) -> Model:
    """Train on documents with a text and a language, chosen by a hash of doc_id.

    At most ``each`` of a language and ``everything`` in all; the counts of
    the languages are taken over the whole table.
    """
    known = docs.select("doc_id", "text", "lang").where("doc_id is not null and text is not null and trim(lang) <> ''")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return train([], [])
    each = min(each, max(1, everything // len(counts)))
    share = F.create_map(*[v for lang, n in counts.items() for v in (F.lit(lang), F.lit(min(1.0, 1.5 * each / n + 20 / n)))])
    at = (F.xxhash64(F.lit(seed), "doc_id") / F.lit(2.0**64)) + 0.5
    rows = known.withColumn("at", at).where(F.col("at") <= share[F.col("lang")]).orderBy("at", "doc_id", "text").limit(2 * everything + 40 * len(counts)).collect()
    texts, langs, taken = [], [], dict.fromkeys(counts, 0)
    for r in rows:
        if taken[r["lang"]] < each:
            taken[r["lang"]] += 1
            texts.append(r["text"])
            langs.append(r["lang"])
    return train(texts, langs)


def predict_batch(texts: pa.Array, model: Model) -> tuple[list[str], list[str], np.ndarray]:
    """Family, language and margin of each text.

    The margin is that of the weakest decision the language had to win.
    """
    cps, at = t.code_points(texts)
    n, k = len(texts), len(model.families)
    sums, counts, starts, _ = summed(cps, model.table, SIZES, BITS)
    begin = np.searchsorted(starts, at)
    total = np.concatenate([np.zeros((1, model.table.shape[1])), np.cumsum(sums, axis=0)])
    number = np.concatenate([[0], np.cumsum(counts)])
    size = number[begin[1:]] - number[begin[:-1]]
    z = (total[begin[1:]] - total[begin[:-1]]) / np.maximum(size, 1)[:, None] + model.bias
    some = (size > 0) & (k > 0)
    if not k:
        return [UNKNOWN] * n, [UNKNOWN] * n, np.zeros(n)
    fam = z[:, :k].argmax(axis=1)
    ranked = np.sort(z[:, :k], axis=1)
    margin = ranked[:, -1] - ranked[:, -2] if k > 1 else np.full(n, np.inf)
    language = np.empty(n, dtype=object)
    for f, name in enumerate(model.families):
        mine = np.flatnonzero(fam == f)
        own = model.members[name]
        votes, weakest = np.zeros((len(mine), len(own))), np.full((len(mine), len(own)), np.inf)
        for j, (one, two) in enumerate(model.pairs):
            if one not in own:
                continue
            a, b, s = own.index(one), own.index(two), z[mine, k + j]
            # a vote counts one, and its margin only parts equal numbers of votes
            votes[:, a] += (s >= 0) + np.tanh(s) / 1e3
            votes[:, b] += (s < 0) - np.tanh(s) / 1e3
            weakest[:, a] = np.minimum(weakest[:, a], s)
            weakest[:, b] = np.minimum(weakest[:, b], -s)
        best = votes.argmax(axis=1)
        language[mine] = np.array(own, dtype=object)[best]
        margin[mine] = np.minimum(margin[mine], weakest[np.arange(len(mine)), best])
    language[~some] = UNKNOWN
    margin = np.where(some & np.isfinite(margin), margin, 0.0)
    return [model.families[f] if s else UNKNOWN for f, s in zip(fam, some, strict=True)], list(language), margin


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, family, language, margin`` for every row of documents.

    A null, empty or wordless text, or a model of no languages, gives ``und``
    for both with margin 0. Repeated rows and null ids are judged like any
    other; ``lang`` isn't read here.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in t.slices(batch, "text"):
                family, language, margin = predict_batch(part.column("text"), shared.value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(family, pa.string()), pa.array(language, pa.string()), pa.array(margin)], ["doc_id", "family", "language", "margin"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, family string, language string, margin double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its language family and language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))
