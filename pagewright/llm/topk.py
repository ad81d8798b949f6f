"""Exact top-k search by block-at-a-time pruning.

Documents are held as forward indexes: for each document the query terms that
it has, with whole-number BM25 impacts. Consecutive documents form blocks that
know the greatest impact of each term. For a query, a block's bound is the sum
of its maxima; blocks are taken in the order of their bounds and scored through
their forward index until the bounds fall below the k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import _text as t
from pagewright.plans.cut import stored

K, K1, B, SCALE, BLOCK = 10, 0.9, 0.4, 1000, 64
#: Queries that one pass holds in a worker; more are searched in several passes.
MAX_QUERIES = 20_000
#: Documents of one shard, the unit that is pruned on its own.
SHARD = 16_384


def word_list(text: str) -> tuple[np.ndarray, list[str]]:
    """Hashes and strings of a text's lower-case words."""
    cps, _ = t.code_points(pa.array([text]))
    low = t.lowered(cps)
    word = t.is_word(low)
    word[-1] = False
    starts, ends = t.runs(word)
    return t.word_hashes(low, starts, ends), ["".join(map(chr, low[a:b])) for a, b in zip(starts, ends, strict=True)]


def _counts(texts: pa.Array, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, and (text, term, count) for the terms, which are sorted hashes."""
    cps, at = t.code_points(texts)
    low = t.lowered(cps)
    word = t.is_word(low)
    if len(word):
        word[-1] = False
    starts, ends = t.runs(word)
    h = t.word_hashes(low, starts, ends)
    place = np.searchsorted(starts, at)
    doc = np.repeat(np.arange(len(texts)), np.diff(place))
    if not len(terms):
        return np.diff(place), *[np.zeros(0, np.int64)] * 3
    term = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
    hit = terms[term] == h
    pair, n = np.unique(doc[hit] * len(terms) + term[hit], return_counts=True)
    return np.diff(place), pair // len(terms), pair % len(terms), n


def _search(ids: np.ndarray, docs: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_terms: int, queries: list[np.ndarray], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, documents, scores) over one shard; docs index ids and are sorted."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    most = np.zeros((blocks, n_terms), np.int32)
    np.maximum.at(most, (docs // BLOCK, terms), impacts)
    cut = np.searchsorted(docs, np.arange(0, blocks + 1) * BLOCK)
    for q, wanted in enumerate(queries):
        if not len(wanted):
            continue
        bound = most[:, wanted].sum(axis=1, dtype=np.int64)
        order = np.argsort(-bound, kind="stable")
        flag = np.zeros(n_terms, bool)
        flag[wanted] = True
        best_s, best_d = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, step = 0, 1
        while at < blocks:
            some = order[at : at + step]
            floor = best_s[k - 1] if len(best_s) >= k else 1
            # equal scores are parted by id, so a block at the k-th score may still win
            some = some[bound[some] >= floor]
            if not len(some):
                break
            lens = cut[some + 1] - cut[some]
            rows = t.ragged(cut[some], lens)
            rows = rows[flag[terms[rows]]]
            d, back = np.unique(docs[rows], return_inverse=True)
            s = np.bincount(back, impacts[rows], len(d)).astype(np.int64)
            best_s, best_d = np.concatenate([best_s, s]), np.concatenate([best_d, d])
            top = np.lexsort((ids[best_d], -best_s))[:k]
            best_s, best_d = best_s[top], best_d[top]
            at += len(order[at : at + step])
            step = min(step * 2, 64)
        yield q, ids[best_d], best_s


def search(docs: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``item_id, doc_id, score, rank``: the k best documents of every query row.

    The score is the sum over the query's different words of floor(1000 x
    BM25), idf as ln(1 + (N - df + 0.5) / (df + 0.5)); documents that share no
    word with the query aren't results, so there may be fewer than k. Equal
    scores are ordered by doc_id. Null texts count as empty; rows without an
    id are left out; of rows that repeat an id, the greatest text counts.
    Counts are taken over all documents.
    """
    spark = docs.sparkSession
    asked = queries.where("item_id is not null").groupBy("item_id").agg(F.max("text").alias("text")).orderBy("item_id")
    results = None
    rows = asked.toLocalIterator()
    corpus = docs.where("doc_id is not null").select("doc_id", "text")
    while True:
        part = [r for _, r in zip(range(MAX_QUERIES), rows)]
        if not part and results is not None:
            return results
        found = _search_some(spark, corpus, part, k)
        results = found if results is None else results.unionByName(found)
        if len(part) < MAX_QUERIES:
            return results


def _search_some(spark: SparkSession, corpus: DataFrame, asked: list, k: int) -> DataFrame:
    words = [np.unique(word_list(r["text"] or "")[0]) for r in asked]
    items = np.array([r["item_id"] for r in asked], dtype=np.int64)
    terms = np.unique(np.concatenate([*words, np.zeros(0, t.U)]))
    shared = spark.sparkContext.broadcast((terms, [np.searchsorted(terms, w) for w in words], items))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value[0]
        for batch in batches:
            for part in t.slices(batch, "text"):
                size, doc, term, n = _counts(part.column("text"), own)
                offsets = np.searchsorted(doc, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(size.astype(np.int32)), t.lists(term, offsets, pa.int32()), t.lists(n, offsets, pa.int32())], ["doc_id", "size", "terms", "counts"])

    forward = corpus.mapInArrow(index, "doc_id long, size int, terms array<int>, counts array<int>")
    # range partitions of doc_id, so that blocks are ranges of documents whatever the files are
    forward = stored(forward.groupBy("doc_id").agg(F.max_by(F.struct("size", "terms", "counts"), F.struct("size", "terms", "counts")).alias("x")).select("doc_id", "x.*"))
    whole = forward.agg(F.count("*").alias("n"), F.sum("size").alias("words")).first()
    n, average = whole["n"], (whole["words"] or 0) / max(whole["n"], 1)
    df = np.zeros(len(terms))
    for r in forward.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        df[r["term"]] = r["count"]
    idf = spark.sparkContext.broadcast(np.log(1 + (n - df + 0.5) / (df + 0.5)))

    def search_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, wanted, items = shared.value

        def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            ids = table["doc_id"].to_numpy()
            size = table["size"].to_numpy()
            lens = table["terms"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
            term = table["terms"].combine_chunks().flatten().to_numpy()
            count = table["counts"].combine_chunks().flatten().to_numpy().astype(np.float64)
            doc = np.repeat(np.arange(len(ids)), lens)
            impact = np.floor(SCALE * idf.value[term] * (count * (K1 + 1)) / (count + K1 * (1 - B + B * size[doc] / max(average, 1e-9)))).astype(np.int64)
            qs, ds, ss = [], [], []
            for q, d, s in _search(ids, doc, term, impact, len(terms), wanted, k):
                qs.append(np.full(len(d), items[q]))
                ds.append(d)
                ss.append(s)
            if qs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (qs, ds, ss)], ["item_id", "doc_id", "score"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= SHARD:
                yield from flush(held)
                held = []
        if held:
            yield from flush(held)

    best = forward.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(search_shard, "item_id long, doc_id long, score long")
    top = best.groupBy("item_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "doc_id"))), 1, k).alias("top"))
    return top.select("item_id", F.posexplode("top").alias("at", "x")).select("item_id", "x.doc_id", (-F.col("x.minus")).alias("score"), (F.col("at") + 1).alias("rank"))


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP7_SQL = f"""
with docs as (select doc_id, max(coalesce(text, '')) as text from documents where doc_id is not null group by 1),
words as (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) as w from docs),
sizes as (select doc_id, len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) as size from docs),
whole as (select count(*) as n, sum(size) / count(*) as average from sizes),
asked as (select distinct item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) as w from benchmark where item_id is not null),
tf as (select doc_id, w, count(*) as c from words where w in (select w from asked) group by all),
df as (select w, count(*) as df from tf group by 1),
impact as (
  select doc_id, w, floor({SCALE} * ln(1 + (n - df + 0.5) / (df + 0.5)) * (c * {K1 + 1}) / (c + {K1} * (1 - {B} + {B} * size / average)))::bigint as i
  from tf join df using (w) join sizes using (doc_id) cross join whole
), scored as (select item_id, doc_id, sum(i)::bigint as score from asked join impact using (w) group by all having sum(i) > 0)
select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from scored qualify rank <= {K}
"""
