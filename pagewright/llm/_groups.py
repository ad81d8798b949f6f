"""Streaming over sorted Arrow batches, group by group, and pairs inside groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm._text import tidy
from pagewright.plans.cut import cut

#: Rows of two or three numbers up to which a table is broadcast (some 30 MB); a longer one is joined by shuffle.
MAX_BROADCAST = 1_000_000
#: Edges up to which components are found in one task (some 100 MB there); more are first made fewer in rounds.
ONE_TASK = 500_000


def free(name: str, columns: list[str]) -> str:
    """The name, with underscores until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, least: int = 50_000) -> Iterator[pa.Table]:
    """Tables of at least ``least`` rows (but the last) in which no group is cut off; rows come sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key)
        if held and rows >= least:
            # where the key of the rows held ends
            values = k.to_numpy(zero_copy_only=False)
            last = held[-1].column(key)[-1].as_py()
            other = np.flatnonzero(values != last)
            end = int(other[0]) if len(other) else batch.num_rows
            if end < batch.num_rows:
                if end:
                    held.append(batch.slice(0, end))
                yield pa.Table.from_batches(held).combine_chunks()
                held, rows = [], 0
                batch = batch.slice(end)
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
    held = []
    tidy()


def column(table: pa.Table, name: str) -> np.ndarray:
    return table[name].combine_chunks().to_numpy(zero_copy_only=False) if isinstance(table[name], pa.ChunkedArray) else table[name].to_numpy()


def binary_rows(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column, end to end, and where each row's begin."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_binary())
    off = np.frombuffer(array.buffers()[1], dtype=np.int64, count=len(array) + array.offset + 1)[array.offset :]
    data = np.frombuffer(array.buffers()[2], dtype=np.uint8) if array.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def to_binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def pairs_in_groups(keys: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of row numbers i < j with equal keys, which are sorted, about ``most`` at a time."""
    n = len(keys)
    if not n:
        return
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    ends = np.repeat(np.concatenate([starts[1:], [n]]), np.diff(np.concatenate([starts, [n]])))
    partners = ends - np.arange(n) - 1
    group = np.cumsum(partners) // most
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [n]])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        p = partners[a:b]
        total = int(p.sum())
        if not total:
            continue
        i = np.repeat(np.arange(a, b), p)
        first = np.concatenate([[0], np.cumsum(p)[:-1]])
        yield i, i + 1 + np.arange(total) - np.repeat(first, p)


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Each row's least connected row."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def few(rows: DataFrame) -> DataFrame:
    """Marked for broadcast if its counted rows are few; otherwise the join shuffles."""
    return F.broadcast(rows) if rows.count() <= MAX_BROADCAST else rows


def blocked(linked: DataFrame, most: int, most_weight: int) -> DataFrame:
    """``id, root, chunks, chunk`` of ``id, root, weight``: a component over either bound is cut into chunks by a hash of the id."""
    crowd = linked.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / most, F.sum("weight") / most_weight)).cast("int").alias("chunks"))
    return linked.join(crowd, "root").select("id", "root", "chunks", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"))


def each_block(rows: DataFrame, *kept: str) -> DataFrame:
    """``block, apart, id, chunk`` and what is kept, sorted block by block.

    A component of one chunk is a block; of one cut up, every two chunks are a
    block (``apart``: only rows of different chunks meet there) and every chunk
    is one, so two ids of a component meet in exactly one block, and no task
    holds more than two chunks.
    """
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    rows = rows.withColumn("other", other).select(
        F.when(F.col("chunks") == 1, F.col("root")).otherwise(F.xxhash64("root", F.least("chunk", "other"), F.greatest("chunk", "other"))).alias("block"),
        (F.col("chunk") != F.col("other")).alias("apart"), "id", "chunk", *kept,
    )
    return rows.repartition("block").sortWithinPartitions("block", "id")


def tables(held: pa.Table, most: int = 2000) -> Iterator[pa.Table]:
    """Whole blocks, several small ones together, of which repeated ids are dropped."""
    block, own = column(held, "block"), column(held, "id")
    new = np.concatenate([[True], (block[1:] != block[:-1]) | (own[1:] != own[:-1])])
    held, block = held.filter(pa.array(new)), block[new]
    cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
    at = 0
    for i in range(1, len(cuts)):
        if cuts[i] - cuts[at] > most or i == len(cuts) - 1:
            yield held.slice(cuts[at], cuts[i] - cuts[at]).combine_chunks()
            at = i


def components(edges: DataFrame) -> DataFrame:
    """``id, root``: the least id of the component, for every id in ``edges`` (a, b).

    Each round lets every id point to its least neighbour, follows the
    pointers to their ends, and keeps the edges between different ends. At
    most half of the ids are ends, so the rounds are logarithmic. Once
    ``ONE_TASK`` edges or less are left, one task does the rest: every round
    is several jobs, whose plans and code stay in the driver's memory.
    """
    edges = cut(edges.where("a <> b").select("a", "b").distinct())
    found = None
    while many := edges.count():
        to = cut(_in_one_task(edges)) if many <= ONE_TASK else _ends(edges)
        if found is None:
            found = to
        else:
            far = to.select(F.col("id").alias("root"), F.col("root").alias("far"))
            found = cut(found.join(far, "root", "left").select("id", F.coalesce("far", "root").alias("root")))
        if many <= ONE_TASK:
            return found
        a, b = to.select(F.col("id").alias("a"), F.col("root").alias("ra")), to.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        edges = cut(edges.join(a, "a").join(b, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    return edges.select(F.col("b").alias("id"), F.col("a").alias("root")) if found is None else found


def _in_one_task(edges: DataFrame) -> DataFrame:
    """``id, root`` of edges that one task can hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([column(batch, "a"), column(batch, "b")]) for batch in batches if batch.num_rows]
        if held:
            ids, at = np.unique(np.concatenate(held, axis=1), return_inverse=True)
            left, right = at.reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[local_roots(len(ids), left, right)])], ["id", "root"])
        held = []
        tidy()

    return edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).coalesce(1).mapInArrow(run, "id long, root long")


def _ends(edges: DataFrame) -> DataFrame:
    """``id, root`` of a round: where the pointers to least neighbours end."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    to = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("root")))
    while True:
        next_ = to.alias("x").join(to.select(F.col("id").alias("root"), F.col("root").alias("far")), "root", "left").select("id", F.coalesce("far", "root").alias("root"), (F.coalesce("far", "root") != F.col("root")).alias("moved"))
        next_ = cut(next_)
        to = next_.select("id", "root")
        if not next_.where("moved").limit(1).count():
            return to
