"""Embedding near-dedup by randomised-rotation binary codes.

Every different unit vector is padded, turned by a seeded random rotation and
kept as the signs of its coordinates, with the correction factor <code, vector>.
For any vector q, <code, q> / factor is an unbiased estimate of <vector, q>, and
the factor gives its confidence bound: only pairs whose upper bound reaches the
threshold are computed exactly.

Vectors meet in tables keyed by samples of code bits; how many bits and tables
follows from the number of vectors and the chance that a bit of two vectors at
the threshold differs (their angle over pi), so that at most ``MISS`` of such
pairs meet nowhere. What travels there is an id and the code; vectors whose
codes are near are linked, and only what hangs together by such links is
fetched as vectors, block by block. A key that very many vectors have, and a
component of very many, are cut into chunks that meet two by two.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import _text as t
from pagewright.llm import _groups
from pagewright.llm._groups import binary_rows, blocked, column, components, each_block, few, local_roots, pairs_in_groups, to_binary, whole_groups
from pagewright.plans.cut import cut, stored

THRESHOLD, MISS, SEED = 0.95, 1e-3, 5
#: Bits of a code at least; standard deviations that confidence bounds allow for (one pair in a million errs by more).
BITS, WIDTH = 256, 5.0
#: Vectors of a block.
BLOCK = 2000


def rotation(dim: int, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """The first ``dim`` rows of a random rotation of max(dim, bits) dimensions, a multiple of 64."""
    size = -(-max(dim, bits) // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))
    return (q * np.sign(np.diag(r)))[:dim]


def tables(n: int, bits: int, threshold: float, miss: float, seed: int = SEED) -> np.ndarray:
    """Which code bits key each table: one row a table."""
    same = 1 - acos(threshold) / pi
    b = min(bits, max(4, ceil(log2(max(n, 2))) - 3))
    many = max(1, ceil(log(miss) / log(1 - same**b)))
    rng = np.random.default_rng(seed + 1)
    return np.stack([rng.choice(bits, b, replace=False) for _ in range(many)])


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs of the turned vectors as bits, one byte each, and their correction factors."""
    y = unit @ turn
    return (y > 0).astype(np.uint8), np.abs(y).sum(axis=1) / sqrt(turn.shape[1])


def estimates(code: np.ndarray, factor: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Unbiased estimates of <vector, q> from a vector's code bits and q turned; rows go together."""
    return (turned * (2.0 * code - 1)).sum(axis=1) / (sqrt(turned.shape[1]) * factor)


def bounds(factor: np.ndarray, bits: int) -> np.ndarray:
    """Half the width of the estimates' confidence intervals."""
    return np.sqrt(np.maximum(1 - factor**2, 0)) / factor * WIDTH / sqrt(bits - 1)


def _keys(code: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Each code's key in every table."""
    keys = np.empty((len(code), len(places)), t.U)
    for i, some in enumerate(places):
        packed = np.packbits(code[:, some], axis=1)
        h = np.full(len(code), i + 1, t.U)
        for c in range(packed.shape[1]):
            h = t.mix(h * t.U(0x9E3779B97F4A7C15) + packed[:, c].astype(t.U))
        keys[:, i] = h
    return keys


def _unit(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def far(bits: int, threshold: float) -> float:
    """Bits by which the codes of two vectors at the threshold differ at most, but for one pair in some 100,000."""
    p = acos(threshold) / pi
    return bits * p + 4.5 * sqrt(bits * p * (1 - p))


def _candidates(rows: DataFrame, dim: int, n: int, threshold: float, miss: float, seed: int) -> DataFrame:
    """Edges (a, b) that hang vectors of near codes together, as many as vectors and tables at most."""
    bits = rotation(dim, seed=seed).shape[1]
    places, most = tables(n, bits, threshold, miss, seed), far(bits, threshold)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dim, seed=seed)
        for batch in batches:
            if batch.num_rows:
                code, _ = encode(_unit(batch.column("v")), turn)
                keys = _keys(code, places)
                owner = np.repeat(np.arange(len(code)), keys.shape[1])
                packed = np.packbits(code, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), batch.column("id").take(pa.array(owner)), to_binary(packed[owner].ravel(), np.arange(len(owner) + 1) * packed.shape[1])], ["root", "id", "code"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dim, seed=seed)
        for batch in batches:
            if batch.num_rows:
                key, many = np.unique(_keys(encode(_unit(batch.column("v")), turn)[0], places), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(many)], ["hot", "n"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in whole_groups(batches, "block", 20_000):
            for table in _groups.tables(held, 20_000):
                code = binary_rows(table["code"])[0].reshape(table.num_rows, -1).view(t.U)
                own, chunk, apart = (column(table, c) for c in ("id", "chunk", "apart"))
                left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for i, j in pairs_in_groups(column(table, "block"), 500_000):
                    near = (np.bitwise_count(code[i] ^ code[j]).sum(axis=1, dtype=np.int64) <= most) & (~apart[i] | (chunk[i] != chunk[j]))
                    left.append(i[near])
                    right.append(j[near])
                root = own[local_roots(len(own), np.concatenate(left), np.concatenate(right))]
                if (root != own).any():
                    edge = np.unique(np.stack([root, own], axis=1)[root != own], axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(edge[:, 0]), pa.array(edge[:, 1])], ["a", "b"])

    hot = rows.mapInArrow(count, "hot long, n long").groupBy("hot").agg(F.sum("n").alias("n")).where(F.col("n") > BLOCK)
    hot = few(cut(hot.select("hot", F.ceil(F.col("n") / BLOCK).cast("int").alias("chunks"))))
    spread = rows.mapInArrow(index, "root long, id long, code binary").join(hot, F.col("root") == F.col("hot"), "left").select("root", "id", "code", F.coalesce("chunks", F.lit(1)).alias("chunks"))
    spread = spread.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    return each_block(spread, "code").mapInArrow(link, "a long, b long").distinct()


def _links(rows: DataFrame, dim: int, n: int, threshold: float, miss: float, seed: int) -> DataFrame:
    """``id, root, n``: for each block a vector has links in, their number and the least vector they lead to."""
    bits = rotation(dim, seed=seed).shape[1]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dim, seed=seed)
        for held in whole_groups(batches, "block", BLOCK):
            for table in _groups.tables(held, BLOCK):
                own, chunk, apart = (column(table, c) for c in ("id", "chunk", "apart"))
                unit = _unit(table["v"].combine_chunks())
                code, factor = encode(unit, turn)
                turned, most = unit @ turn, bounds(factor, bits)
                left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for i, j in pairs_in_groups(column(table, "block"), 20_000):
                    meets = ~apart[i] | (chunk[i] != chunk[j])
                    i, j = i[meets], j[meets]
                    maybe = estimates(code[i], factor[i], turned[j]) + most[i] >= threshold
                    i, j = i[maybe], j[maybe]
                    good = (unit[i] * unit[j]).sum(axis=1) >= threshold
                    left.append(i[good])
                    right.append(j[good])
                i, j = np.concatenate(left), np.concatenate(right)
                links = np.bincount(i, minlength=len(own)) + np.bincount(j, minlength=len(own))
                root, some = own[local_roots(len(own), i, j)], links > 0
                if some.any():
                    yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (own, root, links)], ["id", "root", "n"])

    home = components(_candidates(rows, dim, n, threshold, miss, seed))
    places = cut(blocked(home.withColumn("weight", F.lit(1)), BLOCK, BLOCK))
    members = rows.join(few(places.withColumnRenamed("id", "own")), F.col("id") == F.col("own")).select("id", "root", "chunks", "chunk", "v")
    return each_block(members, "v").mapInArrow(verify, "id long, root long, n long")


def classes(vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, seed: int = SEED) -> DataFrame:
    """``vec_id, class_id, n_links, n_copies`` of every vector.

    Equal vectors are copies; ``n_copies`` counts the others. Two different
    vectors of a cosine at the threshold are linked; ``n_links`` counts the
    different vectors that a vector's is linked to. A class is what hangs
    together by links and copies, ``class_id`` the least vec_id in it.

    Rows without an id are left out. Null, empty or zero vectors and those with
    a null, NaN or infinite entry are classes of their own with nothing linked;
    only vectors of one length can be linked. Of rows that repeat an id, the
    greatest usable embedding counts. Other columns aren't read; an empty table
    gives no rows. At most ``miss`` of the links right at the threshold are
    expected to be missed by the tables, fewer of closer ones.
    """
    square = "aggregate(v, cast(0 as double), (s, x) -> s + x * x)"
    rows = vectors.selectExpr("cast(vec_id as long) as vec_id", "transform(embedding, x -> cast(x as double) + 0.0D) as v").where("vec_id is not null")
    usable = F.expr(f"size(v) > 0 and not exists(v, x -> x is null or isnan(x)) and {square} > 0 and {square} < double('infinity')")
    rows = cut(rows.groupBy("vec_id").agg(F.max(F.when(usable, F.col("v"))).alias("v")).select("vec_id", "v", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g")))
    # one of equal vectors stands for all
    known = cut(rows.where("v is not null").groupBy("h", "g").agg(F.min_by("v", "vec_id").alias("v"), F.min("vec_id").alias("id"), (F.count("*") - 1).alias("n_copies")))
    found = None
    for r in known.groupBy(F.size("v").alias("dim")).count().orderBy("dim").collect():
        own = _links(known.where(F.size("v") == r["dim"]).select("id", "v"), r["dim"], r["count"], threshold, miss, seed)
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "id long, root long, n long")
    found = stored(found)
    links = found.groupBy("id").agg(F.sum("n").alias("n_links"))
    home = components(found.select(F.col("root").alias("a"), F.col("id").alias("b")))
    none = F.lit(0).cast("long")
    some = known.select("h", "g", "id", "n_copies").join(links, "id", "left").where("n_copies > 0 or n_links > 0").join(home, "id", "left")
    # ids are least already, and so are roots: the least id of the least vectors
    some = few(cut(some.select(F.col("h").alias("_h"), F.col("g").alias("_g"), F.coalesce("root", "id").alias("class_id"), F.coalesce("n_links", none).alias("n_links"), "n_copies")))
    joined = rows.select("vec_id", "h", "g", F.col("v").isNotNull().alias("ok")).join(some, F.col("ok") & (F.col("h") == F.col("_h")) & (F.col("g") == F.col("_g")), "left")
    return joined.select("vec_id", F.coalesce("class_id", "vec_id").alias("class_id"), F.coalesce("n_links", none).alias("n_links"), F.coalesce("n_copies", none).alias("n_copies"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding with its class, copies and links at a cosine of 0.95."""
    return classes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP10_SQL = f"""
with recursive rows as (
  select vec_id, max(case when len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x))) = 0
                           and list_dot_product(embedding::double[], embedding::double[]) > 0 and list_dot_product(embedding::double[], embedding::double[]) < 'infinity'::double then embedding::double[] end) as v
  from embeddings where vec_id is not null group by 1
), named as (select vec_id, v, case when v is null then vec_id else min(vec_id) over (partition by v) end as first, case when v is null then 0 else count(*) over (partition by v) - 1 end as copies from rows),
reps as (select vec_id, v, sqrt(list_dot_product(v, v)) as norm from named where vec_id = first and v is not null),
found as (select a.vec_id as x, b.vec_id as y from reps a join reps b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where list_dot_product(a.v, b.v) / a.norm / b.norm >= {THRESHOLD}),
reach as (select x, y from found union select r.x, f.y from reach r join found f on r.y = f.x),
least_of as (select x, min(y) as root from reach group by x),
links as (select x, count(*) as n_links from found group by x)
select vec_id, least(first, coalesce(root, first)) as class_id, coalesce(n_links, 0)::bigint as n_links, copies::bigint as n_copies
from named left join least_of on first = least_of.x left join links on first = links.x
"""
