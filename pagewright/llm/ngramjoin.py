"""N-gram Jaccard join by prefixes, exact.

A document is the set of its word n-grams, put in one order that holds for all
documents: those that look rarest first. Two sets of a Jaccard similarity of at
least the threshold have k n-grams in common among the first of each, as many
as a similar set may lack and k more. So those first n-grams are a set's
signatures, none left out, and the sets of each are brought together; k grows
with the set (``_shared``), as sets that meet by chance meet more often the
longer they are. The order decides how many unlike sets meet, never which
similar ones do: it comes from the words and n-grams of a sample.

Sets that meet are told apart by size, by the places of the n-gram in them, by
how often they meet, and by sketches: parity bitmaps, which differ in no more
bits than the sets in n-grams. What passes is linked, and what hangs together
is compared n-gram by n-gram. A signature of more than ``CROWD`` sets isn't
taken apart into pairs: its sets come together with their sketches and are
compared until those not compared hang together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import _text as t
from pagewright.llm._groups import binary_rows, blocked, column, components, each_block, few, free, local_roots, pairs_in_groups, tables, to_binary, whole_groups
from pagewright.plans.cut import cut, release, stored, sweep

N, THRESHOLD = 2, 0.7
#: Documents, about, whose words and n-grams give the order, and bits of a place in the table of how common they are.
SAMPLE, PLACE_BITS = 20_000, 22
#: Sets of one signature up to which they are taken apart into pairs, and 64-bit words of a sketch beyond, at most: as good as whole, since sketches of less than a bit an n-gram link unlike sets.
CROWD, CROWD_WIDTH = 32, 4096
#: Sets of a crowd that are compared with all one by one and link few, until all that are left are compared at once.
CROWD_FIRST = 4
#: Sets of a block and n-grams of a block, the unit in which sets are compared.
BLOCK, BLOCK_GRAMS = 2000, 4_000_000


def _grams(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every n-gram's text, hash and first word, the last -1 where a text is a single one; every word's hash and text."""
    cps, at = t.code_points(texts)
    low = t.lowered(cps)
    word = t.is_word(low)
    if len(word):
        word[-1] = False
    starts, ends = t.runs(word)
    h = t.word_hashes(low, starts, ends)
    first = np.searchsorted(starts, at)
    size = np.diff(first)
    own = np.repeat(np.arange(len(texts)), size)
    # a text of fewer than n words is one n-gram
    short = np.flatnonzero((size > 0) & (size < n))
    grams = t.window_hashes(h, n)
    ok = np.flatnonzero(own[: len(grams)] == own[n - 1 :]) if len(grams) else np.zeros(0, np.int64)
    whole = np.array([t.mix(h[first[i] : first[i + 1]] * t.powers(t.U(3), size[i] + 1)[1:]).sum(dtype=t.U) for i in short], dtype=t.U)
    return np.concatenate([own[ok], short]), np.concatenate([grams[ok], whole]), np.concatenate([ok, np.full(len(short), -1)]), h, own


def features(texts: pa.Array, n: int, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of every text, hashed, end to end, and where each text's begin; rarest first by ``commonness``, else by hash."""
    doc, value, word, h, _ = _grams(texts, n)
    rank = np.zeros(len(value), np.int64)
    if common is not None and len(h):
        words = np.concatenate([[0], np.cumsum(common[_place(h)], dtype=np.int64)])
        wide = np.flatnonzero(word >= 0)
        # as if words were independent, but no less than what the sample has
        likely = words[word[wide] + n] - words[word[wide]] - (n - 1) * int(common[-1])
        known = common[_place(value[wide])].astype(np.int64)
        rank[wide] = np.where(known > 0, np.maximum(likely, known), likely)
    order = np.lexsort((value, rank, doc))
    doc, value = doc[order], value[order]
    if len(doc):
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])])
        doc, value = doc[new], value[new]
    return value, np.searchsorted(doc, np.arange(len(texts) + 1))


def _place(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> t.U(64 - PLACE_BITS)).astype(np.int64)


def commonness(docs: DataFrame, rows: int, n: int) -> np.ndarray:
    """How many documents of a sample have the words and n-grams of a place, as four times a logarithm; last, what stands for all words."""
    every = max(1, rows // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in t.slices(batch, "text"):
                doc, value, _, h, own = _grams(part.column("text"), n)
                seen = np.unique((np.concatenate([doc, own]) << PLACE_BITS) | _place(np.concatenate([value, h])))
                place, times = np.unique(seen & ((1 << PLACE_BITS) - 1), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(times.astype(np.int32))], ["place", "times"])

    some = _texts(docs).where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0))
    found = some.mapInArrow(run, "place int, times int").groupBy("place").agg(F.sum("times").cast("int").alias("times")).where("times > 2").toArrow()
    table = np.zeros((1 << PLACE_BITS) + 1, np.int8)
    table[column(found, "place")] = np.round(4 * np.log2(column(found, "times"))).clip(0, 127).astype(np.int8)
    # the sample's words, of some 250 a document
    table[-1] = min(127, round(4 * np.log2(250 * max(1, rows / every))))
    return table


def _shared(size: np.ndarray) -> np.ndarray:
    """Signatures that a set has in common with a similar one, unless those or all that the two share are fewer."""
    return 2 + size // 100


def _first(offsets: np.ndarray, threshold: float, shared: np.ndarray | int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(set, place in it) of the n-grams of which a similar set has so many at least: all but as many as both have in common, and those."""
    size = np.diff(offsets)
    some = np.minimum(size, size - np.ceil(threshold * size - 1e-9).astype(np.int64) + shared)
    return np.repeat(np.arange(len(size)), some), t.ragged(np.zeros(len(size), np.int64), some)


def signatures(values: np.ndarray, offsets: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(set, signature) of sets that are all in one order; similar sets share one."""
    owner, at = _first(offsets, threshold)
    return owner, values[offsets[owner] + at]


def _width(size: np.ndarray) -> np.ndarray:
    """64-bit words of a set's sketch: a bit an n-gram at least."""
    return 1 << np.ceil(np.log2(np.maximum(size, 64) / 64)).astype(np.int64)


def sketches(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of every set's sketch, and where each begins: a bit tells whether the n-grams that hash to it are odd in number."""
    size = np.diff(offsets)
    bits = 64 * _width(size)
    start = np.concatenate([[0], np.cumsum(bits)])
    own = np.repeat(np.arange(len(size)), size)
    at = start[own] + (t.mix(values + t.U(0x5DEECE66D)) & (bits[own] - 1).astype(t.U)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=start[-1]) & 1).astype(np.uint8), bitorder="little"), start // 8


def _at_width(data: np.ndarray, start: np.ndarray, width: np.ndarray, to: int) -> np.ndarray:
    """Sketches of at least ``to`` words, one a row, folded to that many; ``start`` counts words."""
    out = np.zeros((len(start), to), t.U)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        out[rows] = np.bitwise_xor.reduce(data[start[rows][:, None] + np.arange(w)].reshape(len(rows), w // to, to), axis=1)
    return out


def _may_differ(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """N-grams in which two similar sets of these sizes differ at most; below 0 if no such sets are similar."""
    least = np.ceil(threshold / (1 + threshold) * (a + b) - 1e-9)
    return np.where(np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-9, a + b - 2 * least, -1)


def _least(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """N-grams that two similar sets of these sizes share at least."""
    return np.ceil(threshold / (1 + threshold) * (a + b) - 1e-9).astype(np.int64)


def _may_meet(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether an n-gram at these places may be one of the first that similar sets share, as many as ``_shared`` asks for."""
    before = np.minimum(_shared(a), _shared(b)) - 1
    return (_may_differ(a, b, threshold) >= 0) & (before + np.minimum(a - at_a, b - at_b) >= _least(a, b, threshold))


def _untold(x: np.ndarray, at_x: np.ndarray, a: np.ndarray, y: np.ndarray, at_y: np.ndarray, b: np.ndarray, threshold: float, widest: int) -> np.ndarray:
    """Of pairs of sets of sizes a and b, those that their sketches, of ``widest`` words at most from at_x of x and at_y of y, don't tell apart."""
    wa, wb, most = np.minimum(_width(a), widest), np.minimum(_width(b), widest), _may_differ(a, b, threshold)
    good = np.zeros(len(a), bool)
    for w in np.unique(np.minimum(wa, wb)):
        every = np.flatnonzero(np.minimum(wa, wb) == w)
        for k in range(0, len(every), max(1, (1 << 19) // int(w))):  # bounds what is gathered at once
            r = every[k : k + max(1, (1 << 19) // int(w))]
            apart = np.bitwise_count(_at_width(x, at_x[r], wa[r], w) ^ _at_width(y, at_y[r], wb[r], w)).sum(axis=1, dtype=np.int64)
            good[r] = apart <= most[r]
    return good


def _alike(table: pa.Table, threshold: float) -> np.ndarray:
    """Of pairs a row, those that their sketches don't tell apart."""
    (x, xo), (y, yo) = binary_rows(table["sketch_a"]), binary_rows(table["sketch_b"])
    return _untold(x.view(t.U), xo[:-1] // 8, column(table, "size_a"), y.view(t.U), yo[:-1] // 8, column(table, "size_b"), threshold, 1 << 31)


def _crowd_roots(size: np.ndarray, at: np.ndarray, data: np.ndarray, start: np.ndarray, threshold: float) -> np.ndarray:
    """Of sets that share a signature, a row of each that hang together; all that may be similar do."""
    n = len(size)

    def near(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = _may_meet(size[i], at[i], size[j], at[j], threshold)
        i, j = i[ok], j[ok]
        ok = _untold(data, start[i], size[i], data, start[j], size[j], threshold, CROWD_WIDTH)
        return i[ok], j[ok]

    root, done, misses = np.arange(n), np.zeros(n, bool), 0
    while True:
        left = np.flatnonzero(~done)
        names, crowd = np.unique(root[left], return_counts=True)
        if len(names) < 2:
            return root
        # sets that are left and hang together need no comparison with each other
        others = root[left] != names[crowd.argmax()]
        if misses >= CROWD_FIRST:
            break
        i = left[others][0]
        found = near(np.full(len(left), i), left)[1]
        misses += len(np.unique(root[found])) - 1 < len(names) / 16
        root[np.isin(root, root[found])] = root[i]
        done[i] = True
    # few hang together: all others at once
    some, rest = left[others], left[~others]
    every = np.concatenate([some, rest])
    edges = [(np.arange(n), root)]
    step = max(1, 500_000 // len(every))
    for k in range(0, len(some), step):
        i, j = np.meshgrid(np.arange(k, min(k + step, len(some))), np.arange(k, len(every)), indexing="ij")
        later = j > i
        edges.append(near(every[i[later]], every[j[later]]))
    return local_roots(n, *(np.concatenate(x) for x in zip(*edges, strict=True)))


def _identity(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    total = np.concatenate([np.zeros(1, t.U), np.cumsum(t.mix(values + t.U(11)), dtype=t.U)])
    return t.mix(total[offsets[1:]] - total[offsets[:-1]] + np.diff(offsets).astype(t.U)).view(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _named(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id, set_hash, size, sketch`` of every document; a text without words has no set_hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in t.slices(batch, "text"):
                values, offsets = features(part.column("text"), n)
                size = np.diff(offsets)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(_identity(values, offsets), mask=size == 0), pa.array(size.astype(np.int32)), to_binary(*sketches(values, offsets))], ["doc_id", "set_hash", "size", "sketch"])

    return _texts(docs).mapInArrow(run, "doc_id long, set_hash long, size int, sketch binary").distinct()


def _meetings(docs: DataFrame, common: np.ndarray, n: int, threshold: float) -> DataFrame:
    """Pairs (a, b) of sets that share ``times`` signatures, of ``least`` that similar ones do, counted in parts; of crowds, instead, (a, signature b, place at) of every set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in t.slices(batch, "text"):
                values, offsets = features(part.column("text"), n, common)
                owner, at = _first(offsets, threshold, _shared(np.diff(offsets)))
                own, size = _identity(values, offsets)[owner], np.diff(offsets)[owner]
                yield pa.RecordBatch.from_arrays([pa.array(values[offsets[owner] + at].view(np.int64)), pa.array(own), pa.array(size.astype(np.int32)), pa.array(at.astype(np.int32))], ["signature", "id", "size", "at"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many, names = [], 0, ["a", "b", "at", "times", "least"]

        def pairs() -> pa.RecordBatch:
            a, b, least = np.concatenate(held, axis=1)
            order = np.lexsort((b, a))
            a, b, least = a[order], b[order], least[order].astype(np.int32)
            new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            times = np.diff(np.concatenate([new, [len(a)]])).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new]), pa.nulls(len(new), pa.int32()), pa.array(times), pa.array(least[new])], names)

        for table in whole_groups(batches, "signature"):
            key, own, size, at = (column(table, c) for c in ("signature", "id", "size", "at"))
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])])
            key, own, size, at = key[new], own[new], size[new].astype(np.int64), at[new]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sets = np.repeat(np.diff(np.concatenate([start, [len(key)]])), np.diff(np.concatenate([start, [len(key)]])))
            crowd = sets > CROWD
            if crowd.any():
                yield pa.RecordBatch.from_arrays([pa.array(own[crowd]), pa.array(key[crowd]), pa.array(at[crowd]), *[pa.nulls(int(crowd.sum()), pa.int32())] * 2], names)
            some = (sets > 1) & ~crowd
            key, own, size, at = key[some], own[some], size[some], at[some]
            for i, j in pairs_in_groups(key, 500_000):
                near = _may_meet(size[i], at[i], size[j], at[j], threshold)
                i, j = i[near], j[near]
                # the n-grams of one that are the other's too may be fewer than are asked for
                least = np.minimum(np.minimum(_shared(size[i]), _shared(size[j])), _least(size[i], size[j], threshold))
                held.append(np.stack([own[i], own[j], least]))
                many += held[-1].shape[1]
                if many > 500_000:
                    yield pairs()
                    held, many = [], 0
        if many:
            yield pairs()

    rows = _texts(docs).where("text is not null").mapInArrow(sign, "signature long, id long, size int, at int")
    return rows.repartition("signature").sortWithinPartitions("signature", "id").mapInArrow(meet, "a long, b long, at int, times int, least int")


def _links(met: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) between sets of ``_meetings`` that their sketches don't tell apart; of a crowd, as many as its sets, not as its pairs."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(_alike(pa.table(batch), threshold))).select(["a", "b"])

    def brief(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = binary_rows(batch.column("sketch"))
            width = np.diff(off) // 8
            if (width > CROWD_WIDTH).any():
                data, start = data.view(t.U), off[:-1] // 8
                short = [_at_width(data, start[[i]], width[[i]], min(width[i], CROWD_WIDTH)).tobytes() for i in range(len(width))]
                batch = batch.set_column(batch.schema.get_field_index("sketch"), "sketch", pa.array(short, pa.binary()))
            yield batch

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "signature", 5000):
            key, own, size, at = (column(table, c) for c in ("signature", "id", "size", "at"))
            data, off = binary_rows(table["sketch"])
            data, start = data.view(t.U), off[:-1] // 8
            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            edge = []
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                mine = own[i:j]
                root = mine[_crowd_roots(size[i:j].astype(np.int64), at[i:j], data, start[i:j], threshold)]
                edge.append(np.stack([root, mine], axis=1)[root != mine])
            edge = np.unique(np.concatenate(edge), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(edge[:, 0]), pa.array(edge[:, 1])], ["a", "b"])

    def side(x: str) -> DataFrame:
        return sets.select(F.col("set_hash").alias(x), F.col("weight").alias(f"size_{x}"), F.col("sketch").alias(f"sketch_{x}"))

    pairs = met.where("at is null").groupBy("a", "b").agg(F.sum("times").alias("times"), F.max("least").alias("least")).where("times >= least").select("a", "b")
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(told, "a long, b long")
    crowds = met.where("at is not null").select(F.col("a").alias("set_hash"), F.col("b").alias("signature"), "at").join(sets, "set_hash")
    crowds = crowds.select("signature", F.col("set_hash").alias("id"), F.col("weight").alias("size"), "at", "sketch").mapInArrow(brief, "signature long, id long, size int, at int, sketch binary")
    crowds = crowds.repartition("signature").sortWithinPartitions("signature", "id").mapInArrow(gather, "a long, b long")
    return pairs.unionByName(crowds)


def _similar(table: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two sets of one block that reach the threshold, each pair once."""
    data, off = binary_rows(table["features"])
    grams = data.view(t.U)
    values, inverse, times = np.unique(grams, return_inverse=True, return_counts=True)
    off = off // 8
    size = np.diff(off)
    rare = np.lexsort((inverse, times[inverse], np.repeat(np.arange(len(size)), size)))
    chunk, apart, block = column(table, "chunk"), column(table, "apart"), column(table, "block")
    row, key = signatures(inverse[rare], off, threshold)
    order = np.lexsort((row, key, block[row]))
    row, key, pairs = row[order], key[order], np.zeros(0, np.int64)
    group = np.cumsum(np.diff(key, prepend=key[:1]).astype(bool) | np.diff(block[row], prepend=block[row][:1]).astype(bool))
    crowd, whole = np.bincount(group), np.unique(block, return_counts=True)[1]
    # where sets share very many signatures, all pairs of a block are fewer
    dense = (crowd * (crowd - 1)).sum() > (whole * (whole - 1)).sum()
    for i, j in pairs_in_groups(block) if dense else pairs_in_groups(group):
        i, j = (i, j) if dense else (row[i], row[j])
        # chunks of one block that is made of two only meet each other
        near = (i != j) & (np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9) & (~apart[i] | (chunk[i] != chunk[j]))
        found = i[near] * np.int64(len(size)) + j[near]
        pairs = np.concatenate([pairs, found]) if dense else np.union1d(pairs, found)
    left, right = pairs // max(len(size), 1), pairs % max(len(size), 1)
    common = np.zeros(len(pairs), np.int64)
    flag = np.zeros(len(values), np.int8)
    cuts = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1], [True]])) if len(left) else np.zeros(0, int)
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        own = inverse[off[left[i]] : off[left[i] + 1]]
        flag[own] = 1
        for k in range(i, j, 500):  # bounds what is gathered at once
            r = right[k : min(k + 500, j)]
            got = flag[inverse[t.ragged(off[r], size[r])]]
            common[k : k + len(r)] = np.add.reduceat(got, np.concatenate([[0], np.cumsum(size[r])[:-1]]), dtype=np.int64)
        flag[own] = 0
    good = common >= (size[left] + size[right] - common) * threshold - 1e-9
    return left[good], right[good]


def _blocks(docs: DataFrame, signed: DataFrame, n: int, threshold: float) -> DataFrame:
    """Sets by block, with their n-grams; see ``blocked``."""
    sets = signed.where("size > 0").groupBy("set_hash").agg(F.min("doc_id").alias("doc_id"), F.max("size").alias("weight"))
    known = stored(signed.where("size > 0").groupBy("set_hash").agg(F.max("size").alias("weight"), F.max("sketch").alias("sketch")))
    met = stored(_meetings(docs, commonness(docs, signed.count(), n), n, threshold))
    # the shuffled signatures are more than the documents
    sweep(docs.sparkSession)
    linked = components(_links(met, known, threshold)).join(sets, F.col("id") == F.col("set_hash"))
    for table in (met, known):
        release(table)
    sweep(docs.sparkSession)
    places = blocked(linked.select("id", "root", "weight"), BLOCK, BLOCK_GRAMS)
    wanted = cut(places.join(sets.select("set_hash", "doc_id"), F.col("id") == F.col("set_hash")).select("doc_id", F.col("id").alias("wanted"), "root", "chunks", "chunk"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in t.slices(batch, "text"):
                values, offsets = features(part.column("text"), n)
                # of rows that repeat an id, those with the set itself
                same = pa.array(_identity(values, offsets) == part.column("wanted").to_numpy())
                kept = [part.column(c) for c in ("wanted", "root", "chunks", "chunk")]
                yield pa.RecordBatch.from_arrays([*kept, to_binary(values.view(np.uint8), offsets * 8)], ["id", "root", "chunks", "chunk", "features"]).filter(same)

    full = _texts(docs).where("text is not null").join(few(wanted), "doc_id").mapInArrow(run, "id long, root long, chunks int, chunk int, features binary")
    return each_block(full, "features")


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, class_id, n_links, n_copies`` of every document.

    Documents with equal sets of n-grams are copies; ``n_copies`` counts the
    others. Two different sets at the threshold are linked; ``n_links`` counts
    the sets that a document's is linked to. A class is what hangs together by
    links and copies, ``class_id`` the least doc_id in it.

    Words are runs of letters and digits in lower case; a text of 1 to n - 1
    words is a single n-gram. Null texts and texts without words are classes of
    their own with nothing linked; rows without an id are left out. Repeated
    rows count once; rows that share an id and not the n-grams are different
    texts with a row each. An empty table gives no rows.
    """
    signed = stored(_named(docs, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in whole_groups(batches, "block", BLOCK):
            for table in tables(held):
                left, right = _similar(table, threshold)
                links = np.bincount(left, minlength=table.num_rows) + np.bincount(right, minlength=table.num_rows)
                own = column(table, "id")
                root = own[local_roots(table.num_rows, left, right)]
                some = links > 0
                if some.any():
                    yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (own, root, links)], ["id", "root", "n"])

    found = stored(_blocks(docs, signed, n, threshold).mapInArrow(run, "id long, root long, n long"))
    sweep(docs.sparkSession)
    links = found.groupBy("id").agg(F.sum("n").alias("n_links"))
    home = components(found.select(F.col("root").alias("a"), F.col("id").alias("b")))
    sets = signed.where("size > 0").groupBy("set_hash").agg(F.min("doc_id").alias("first"), (F.count("*") - 1).alias("n_copies"))
    sets = sets.join(links, F.col("set_hash") == F.col("id"), "left").where("n_copies > 0 or n_links > 0").drop("id")
    sets = cut(sets.join(home, F.col("set_hash") == F.col("id"), "left").select("set_hash", "first", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "set_hash").alias("root")))
    least = sets.groupBy("root").agg(F.min("first").alias("class_id"))
    known = few(cut(sets.join(least, "root").select("set_hash", "class_id", "n_links", "n_copies")))
    none = F.lit(0).cast("long")
    return signed.join(known, "set_hash", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", none).alias("n_links"), F.coalesce("n_copies", none).alias("n_copies"))


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """Documents, all columns, without all but the least doc_id of each class.

    Rows that repeat an id are one document, of which one row stays: that with
    the greatest text, null being least. Rows without an id stay.
    """
    links = cut(classes(docs, n, threshold).where("class_id <> doc_id").select(F.col("class_id").alias("a"), F.col("doc_id").alias("b")))
    goes, again, one = (free(x, docs.columns) for x in ("_goes", "_again", "_one"))
    counts = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias(again)).agg(F.count("*").alias("n"))
    many = cut(counts.where("n > 1").select(again))
    if not many.limit(1).count():
        return docs.join(few(links.select(F.col("b").alias(goes))), F.col("doc_id") == F.col(goes), "left_anti")
    # an id of several texts may join classes
    lost = cut(components(links).where("id <> root").select(F.col("id").alias(goes)))
    stay = docs.join(few(lost), F.col("doc_id") == F.col(goes), "left_anti")
    rows = stay.join(many, F.col("doc_id") == F.col(again), "left_semi").groupBy(F.col("doc_id").alias(again))
    first = rows.agg(F.max_by(F.struct(*docs.columns), F.struct(F.col("text").isNotNull(), "text")).alias(one)).select(f"{one}.*")
    return stay.join(many, F.col("doc_id") == F.col(again), "left_anti").unionByName(first)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class, copies and links at a Jaccard similarity of 0.7 of word 2-grams."""
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = f"""
with recursive docs as (select distinct doc_id, text from documents where doc_id is not null),
words as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') as w from docs),
sets as (
  select distinct doc_id, list_sort(list_distinct(case when len(w) = 0 then [] when len(w) < {N} then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - {N} + 2), lambda i: array_to_string(w[i : i + {N} - 1], ' ')) end)) as s
  from words
), named as (select doc_id, s, len(s) as n, min(doc_id) over (partition by s) as first, count(*) over (partition by s) - 1 as copies from sets),
grams as (select doc_id, n, unnest(s) as g from named where doc_id = first),
found as (
  select a.doc_id as x, b.doc_id as y
  from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id and least(a.n, b.n) >= {THRESHOLD} * greatest(a.n, b.n) - 1e-9
  group by all having count(*) >= any_value(a.n + b.n) * {THRESHOLD} - count(*) * {THRESHOLD} - 1e-9
), reach as (select x, y from found union select r.x, f.y from reach r join found f on r.y = f.x),
least_of as (select x, min(y) as root from reach group by x),
links as (select x, count(*) as n_links from found group by x)
select doc_id, case when n = 0 then doc_id else least(first, coalesce(root, first)) end as class_id,
       case when n = 0 then 0 else coalesce(n_links, 0) end::bigint as n_links, case when n = 0 then 0 else copies end::bigint as n_copies
from named left join least_of on first = least_of.x left join links on first = links.x
"""
