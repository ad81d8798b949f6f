"""Substring dedup by relative Lempel-Ziv parsing.

Documents are sequences of words. The reference is the corpus itself, and its
index holds every different window of 50 words once, at its first occurrence in
the order of documents: the text around such a place, as far as it matches, is
a reference block. A document is parsed greedily from left to right: of all
blocks that match at the next word, the one whose match goes on longest gives
the factor, and the next factor begins where it ends, so factors don't overlap.
At a factor's beginning a match counts if it has 50 words with those before the
boundary, so the factors cover exactly the words of all repeated windows.
Words that no block matches are literals and stay.

Windows are hashed to 64 bits and looked up under their anchor, the least hash
of the 36 runs of 15 words that make them up: equal windows have equal anchors,
so only windows that share one have to meet. Anchors of very many passages are
taken apart into windows, whose first occurrences are aggregated before they
are shuffled. Whether two places match is read off the places where their
windows first occur, without going back to the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import _text as t
from pagewright.llm._groups import binary_rows, column, few, free, to_binary, whole_groups
from pagewright.plans.cut import cut, stored

#: Words of the shortest duplicate span, and of the runs that are hashed for anchors.
LEAST, GRAM = 50, 15
#: Passages of one anchor up to which a task takes them together.
HOT = 5_000
#: Rows that a task looks at together, if groups are small; bounds a worker's memory.
ROWS = 5_000
PIECE = "doc_id long, text_hash int, first long, last long, ref_doc_id long, ref_text_hash int, ref_first long"


def _words(cps: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of white-space words, and the number of words before each text."""
    starts, ends = t.runs(t.is_solid(cps))
    return starts, ends, np.searchsorted(starts, at)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Where the least value of each ``width`` consecutive ones is; the rightmost of equal ones."""
    best, span = np.arange(len(h)), 1
    while span < width:
        step = min(span, width - span)
        left, right = best[:-step], best[step:]
        best = np.where(h[right] <= h[left], right, left)
        span += step
    return best


def _regions(texts: pa.Array, least: int, gram: int, hashes: bool = True) -> tuple[np.ndarray, ...]:
    """One region an anchor: (text, anchor hash, anchor's place, first window, windows, all windows' hashes if wanted)."""
    cps, at = t.code_points(texts)
    starts, ends, first = _words(cps, at)
    words = t.word_hashes(cps, starts, ends)
    if len(words) < least:
        return (*[np.zeros(0, np.int64)] * 5, np.zeros(0, t.U))
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    grams = t.window_hashes(words, gram)
    anchor = _least(grams, least - gram + 1)
    n = len(words) - least + 1
    whole = t.window_hashes(words, least) if hashes else np.zeros(n, t.U)
    j = np.flatnonzero(doc[:n] == doc[least - 1 :])
    if not len(j):
        return (*[np.zeros(0, np.int64)] * 5, np.zeros(0, t.U))
    a = anchor[j]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (doc[j[1:]] != doc[j[:-1]])]))
    count = np.diff(np.concatenate([new, [len(j)]]))
    base = first[doc[j[new]]]
    return doc[j[new]], grams[a[new]].view(np.int64), a[new] - base, j[new] - base, count, whole[j]


def _lookup(table: pa.Table) -> pa.RecordBatch | None:
    """Runs of windows that occur before, of the regions of some whole anchors, in order of anchor, document and place."""
    anchor = column(table, "anchor")
    several = np.zeros(len(anchor), bool)
    same = anchor[1:] == anchor[:-1]
    several[1:] |= same
    several[:-1] |= same
    if not several.any():
        return None
    table = table.filter(pa.array(several))
    anchor, doc, text, place, first = (column(table, c) for c in ("anchor", "doc_id", "text_hash", "place", "first"))
    data, off = binary_rows(table["windows"])
    window = data.view("<u8")
    count = np.diff(off) // 8
    row = np.repeat(np.arange(len(anchor)), count)
    start = np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    pos = first[row] + np.arange(len(row)) - start
    # equal windows stand at the same distance from their anchor
    where = (pos - place[row]).astype(np.int64).view(t.U)
    key = t.mix(anchor.view(t.U)[row] + t.mix(window + t.mix(where)))
    _, one, back = np.unique(key, return_index=True, return_inverse=True)
    ref = one[back]
    r, p = row[ref], pos[ref]
    dup = ~((doc[r] == doc[row]) & (text[r] == text[row]) & (p == pos))
    if not dup.any():
        return None
    k = np.flatnonzero(dup)
    go = (row[k[1:]] == row[k[:-1]]) & (k[1:] == k[:-1] + 1) & (doc[r[k[1:]]] == doc[r[k[:-1]]]) & (text[r[k[1:]]] == text[r[k[:-1]]]) & (p[k[1:]] == p[k[:-1]] + 1)
    head = np.flatnonzero(np.concatenate([[True], ~go]))
    tail = np.concatenate([head[1:], [len(k)]]) - 1
    h, e = k[head], k[tail]
    return pa.RecordBatch.from_arrays(
        [pa.array(x) for x in (doc[row[h]], text[row[h]], pos[h].astype(np.int64), pos[e].astype(np.int64), doc[r[h]], text[r[h]], p[h].astype(np.int64))],
        ["doc_id", "text_hash", "first", "last", "ref_doc_id", "ref_text_hash", "ref_first"],
    )


def _occurrences(docs: DataFrame, least: int, gram: int) -> DataFrame:
    """Pieces of every document whose windows occur earlier, with where they first do."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in t.slices(batch, "text"):
                doc, anchor, place, first, count, windows = _regions(part.column("text"), least, gram)
                take = pa.array(doc)
                offsets = np.concatenate([[0], np.cumsum(count * 8)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor, pa.int64()), part.column("doc_id").take(take), part.column("text_hash").take(take), pa.array(place.astype(np.int32)), pa.array(first.astype(np.int32)), to_binary(windows.view(np.uint8), offsets)],
                    ["anchor", "doc_id", "text_hash", "place", "first", "windows"],
                )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in t.slices(batch, "text"):
                anchor, n = np.unique(_regions(part.column("text"), least, gram, False)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(n, pa.int64())], ["hot", "n"])

    def lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "anchor", ROWS):
            found = _lookup(table)
            if found is not None:
                yield found

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = binary_rows(batch.column("windows"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(off) // 8)
            pos = column(batch, "first")[row].astype(np.int64) + np.arange(len(row)) - off[:-1][row] // 8
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("anchor").take(take), pa.array(data.view("<i8")), pa.array(pos - column(batch, "place")[row]), batch.column("doc_id").take(take), batch.column("text_hash").take(take), pa.array(pos)], ["anchor", "window", "distance", "doc_id", "text_hash", "first"])

    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("text_hash"), "text")
    regions = rows.mapInArrow(index, "anchor long, doc_id long, text_hash int, place int, first int, windows binary")
    hot = cut(rows.select("text").mapInArrow(count, "hot long, n long").groupBy("hot").agg(F.sum("n").alias("n")).where(F.col("n") > HOT).select("hot"))
    any_hot = hot.limit(1).count()
    cold = regions.join(few(hot), F.col("anchor") == F.col("hot"), "left_anti") if any_hot else regions
    found = cold.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "text_hash", "first").mapInArrow(lookup, PIECE)
    if any_hot:
        own = ["anchor", "window", "distance"]
        windows = regions.join(few(hot), F.col("anchor") == F.col("hot"), "left_semi").mapInArrow(apart, "anchor long, window long, distance long, doc_id long, text_hash int, first long")
        firsts = cut(windows.groupBy(own).agg(F.min(F.struct("doc_id", "text_hash", "first")).alias("ref"), F.count("*").alias("n")).where("n > 1").drop("n"))
        again = windows.join(few(firsts), own).where(F.struct("doc_id", "text_hash", "first") != F.col("ref"))
        found = found.unionByName(again.select("doc_id", "text_hash", "first", F.col("first").alias("last"), F.col("ref.doc_id").alias("ref_doc_id"), F.col("ref.text_hash").alias("ref_text_hash"), F.col("ref.first").alias("ref_first")))
    return found


def _line(table: pa.Table, least: int) -> pa.RecordBatch:
    """Pieces of whole documents joined to segments; each knows its region, which are segments whose words overlap."""
    names = ["doc_id", "text_hash", "first", "last", "ref_doc_id", "ref_text_hash", "ref_first"]
    doc, text, first, last, rdoc, rtext, rfirst = (column(table, c) for c in names)
    order = np.lexsort((first, rfirst - first, rtext, rdoc, text, doc))
    x = [v[order] for v in (doc, text, rdoc, rtext, rfirst - first)]
    first, last = first[order], last[order]
    # repeated rows give equal pieces; others don't overlap
    new = np.concatenate([[True], np.any([v[1:] != v[:-1] for v in x], axis=0) | (first[1:] > last[:-1] + 1)])
    start = np.flatnonzero(new)
    last = np.maximum.reduceat(last, start)
    doc, text, rdoc, rtext, shift = (v[start] for v in x)
    first = first[start]
    order = np.lexsort((first, text, doc))
    doc, text, rdoc, rtext, shift, first, last = (v[order] for v in (doc, text, rdoc, rtext, shift, first, last))
    own = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])]))
    # windows of segments are disjoint, so that their last ones ascend with the first ones
    region = np.concatenate([[True], (own[1:] != own[:-1]) | (first[1:] >= last[:-1] + least)])
    start = np.flatnonzero(region)
    size = np.diff(np.concatenate([start, [len(own)]]))
    low, high = np.repeat(first[start], size), np.repeat(last[start + size - 1], size)
    return pa.RecordBatch.from_arrays([pa.array(v) for v in (doc, text, first, last, rdoc, rtext, first + shift, low, high, np.repeat(size, size) > 1)], [*names, "low", "high", "several"])


def _greedy(own: list[tuple], other: list[tuple], least: int) -> Iterator[tuple[int, int, tuple, int]]:
    """Factors (start word, end word, reference, place in it) of one region.

    ``own``: its segments (first, last, reference, shift); ``other``: of the
    references' own segments (reference, first, last, their reference, their
    shift). Both say where words first occur, so that two places match where
    they say the same; every other window of a reference is its own first one.
    """
    number: dict[tuple, int] = {}
    name = lambda ref: number.setdefault(ref, len(number)) << 40
    low, high = min(x[0] for x in own), max(x[1] for x in own)
    here = np.full(high - low + 1, -1, np.int64)
    lines: dict[tuple, dict[int, list[tuple[int, int]]]] = {}
    for first, last, ref, shift in own:
        here[first - low : last - low + 1] = name(ref) + np.arange(first + shift, last + shift + 1)
        lines.setdefault(ref, {}).setdefault(shift, []).append((first, last))
    theirs: dict[tuple, list[tuple]] = {}
    for ref, *x in other:
        theirs.setdefault(ref, []).append(x)
    runs: list[tuple[int, int, tuple, int]] = []
    for ref, shifts in lines.items():
        start, end = low + min(shifts), high + max(shifts)
        there = np.arange(start, end + 1)
        there = np.where(there < 0, -2, name(ref) + there)
        for first, last, far, shift in theirs.get(ref, ()):
            a, b = max(first, start), min(last, end)
            if a <= b:
                there[a - start : b - start + 1] = name(far) + np.arange(a + shift, b + shift + 1)
        for shift, known in shifts.items():
            at = low + shift - start
            apart = np.flatnonzero(here != there[at : at + len(here)])
            for i in {int(np.searchsorted(apart, first - low)) for first, _ in known}:
                a = int(apart[i - 1]) + 1 if i else 0
                b = int(apart[i]) - 1 if i < len(apart) else len(here) - 1
                runs.append((a + low, b + low + least, ref, shift))
    runs.sort(key=lambda r: r[0])
    at, i, best = runs[0][0], 0, None
    while True:
        while i < len(runs) and runs[i][0] <= at:
            r = runs[i]
            if best is None or (-r[1], r[2], r[3]) < (-best[1], best[2], best[3]):
                best = r
            i += 1
        if best is None or best[1] <= at:
            return
        yield at, best[1], best[2], at + best[3]
        at = best[1]


def duplicate_spans(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """``doc_id, text_hash, start_word, end_word, ref_doc_id, ref_start_word``: the factors of every document.

    A window of ``least`` words (cut at tab, newline, form feed, return and
    space) is repeated if the same words occur earlier, in the order of doc_id,
    a hash of the text, and place. Words ``start_word`` up to, not including,
    ``end_word`` also stand at ``ref_start_word`` of ``ref_doc_id``, which may
    be earlier in the same document. A factor is the longest of the matches at
    its start, each as long as its document and reference agree, that hold the
    first occurrence of one of their windows; of equally long ones it is that
    of the least reference and place. Factors don't overlap, and cover all
    words of repeated windows.

    Rows without an id or a text, and texts under ``least`` words, have none;
    wholly repeated rows are one document; rows that share an id and not the
    text are different documents. An empty table gives no rows.
    """

    def line(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "key", ROWS):
            yield _line(table, least)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "key", ROWS):
            kind = column(table, "kind")
            v = [column(table, c).tolist() for c in ("doc_id", "text_hash", "low", "a", "b", "rd", "rt", "shift", "fd", "ft", "far_shift")]
            regions: dict[tuple, tuple[list, list]] = {}
            for k, doc, text, low, a, b, rd, rt, shift, fd, ft, far in zip(kind.tolist(), *v, strict=True):
                own, other = regions.setdefault((doc, text, low), ([], []))
                if k == 0:
                    own.append((a, b, (rd, rt), shift))
                else:
                    other.append(((rd, rt), a, b, (fd, ft), far))
            out = [(doc, text, start, end, ref[0], place) for (doc, text, _), (own, other) in regions.items() for start, end, ref, place in _greedy(own, other, least)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(zip(*out, strict=True))], ["doc_id", "text_hash", "start_word", "end_word", "ref_doc_id", "ref_start_word"])

    keyed = _occurrences(docs, least, gram).withColumn("key", F.xxhash64("doc_id", "text_hash"))
    segments = stored(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(line, f"{PIECE}, low long, high long, several boolean"))
    one = segments.where("not several").select("doc_id", "text_hash", F.col("first").alias("start_word"), (F.col("last") + least).alias("end_word"), "ref_doc_id", F.col("ref_first").alias("ref_start_word"))
    # matches go on where the reference's own segments say so
    several = segments.where("several").selectExpr("doc_id", "text_hash", "low", "high", "first as a", "last as b", "ref_doc_id as rd", "ref_text_hash as rt", "ref_first - first as shift")
    # a reference's segments come once a region, not once a match: periodic texts have very many matches with one reference
    lines = several.groupBy("doc_id", "text_hash", "low", "high", "rd", "rt").agg((F.col("low") + F.min("shift")).alias("start"), (F.col("high") + F.max("shift")).alias("end"))
    theirs = segments.selectExpr("doc_id as zd", "text_hash as zt", "first as za", "last as zb", "ref_doc_id as fd", "ref_text_hash as ft", "ref_first - first as far_shift")
    meet = (F.col("rd") == F.col("zd")) & (F.col("rt") == F.col("zt")) & (F.col("zb") >= F.col("start")) & (F.col("za") <= F.col("end"))
    far = lines.join(theirs, meet).selectExpr("doc_id", "text_hash", "low", "1 as kind", "za as a", "zb as b", "rd", "rt", "0L as shift", "fd", "ft", "far_shift")
    own = several.selectExpr("doc_id", "text_hash", "low", "0 as kind", "a", "b", "rd", "rt", "shift", "0L as fd", "0 as ft", "0L as far_shift")
    rows = own.unionByName(far).withColumn("key", F.xxhash64("doc_id", "text_hash", "low"))
    many = rows.repartition("key").sortWithinPartitions("key").mapInArrow(parse, "doc_id long, text_hash int, start_word long, end_word long, ref_doc_id long, ref_start_word long")
    return one.unionByName(many)


def cut_text(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans; of white space around them, what stood before stays."""
    cps, at = t.code_points(pa.array([text]))
    starts, ends, _ = _words(cps, at)
    keep = np.ones(len(cps) - 1, bool)
    for a, b in spans:
        keep[starts[a] : starts[b] if b < len(starts) else len(keep)] = False
    return cps[:-1][keep].tobytes().decode("utf-32-le", "surrogatepass")


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Documents, all columns, without their duplicate spans; ``n_chars``, if there, counts anew.

    The first occurrence of every passage stays. A document of which nothing
    but white space is left goes, unless it was so before. A text without
    spans, a null text and a null id are left alone.
    """
    # one shuffle of the texts, on the key the spans already have
    doc, hashed, own = (free(x, docs.columns) for x in ("_doc", "_hash", "_spans"))
    span = F.struct(F.col("start_word").alias("a"), F.col("end_word").alias("b"))
    per = spans.groupBy(F.col("doc_id").alias(doc), F.col("text_hash").alias(hashed)).agg(F.sort_array(F.collect_list(span)).alias(own))
    joined = docs.join(per, (F.col("doc_id") == F.col(doc)) & (F.hash("text") == F.col(hashed)), "left").drop(doc, hashed)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in t.slices(batch, "text"):
                texts, found = part.column("text").to_pylist(), part.column(own).to_pylist()
                out = [x if s is None else cut_text(x, [(y["a"], y["b"]) for y in s]) for x, s in zip(texts, found, strict=True)]
                stay = pa.array([s is None or bool(x.strip()) for x, s in zip(out, found, strict=True)])
                columns = {c: part.column(c) for c in names} | {"text": pa.array(out, part.column("text").type)}
                if "n_chars" in columns:
                    was = columns["n_chars"]
                    columns["n_chars"] = pa.array([o if s is None else len(x) for o, x, s in zip(was.to_pylist(), out, found, strict=True)], was.type)
                yield pa.RecordBatch.from_arrays([columns[c] for c in names], names).filter(stay)

    return joined.mapInArrow(run, docs.schema)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The factors of all documents that make up repeated passages of 50 words or more."""
    return duplicate_spans(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "start_word", "end_word", "ref_doc_id", "ref_start_word")


OP8_SQL = rf"""
with recursive docs as (select distinct doc_id, text from documents where doc_id is not null and text is not null),
words as (select doc_id, regexp_extract_all(text, '[^\t\n\f\r ]+') as w from docs),
windows as (select doc_id, unnest(range(len(w) - {LEAST - 1})) as pos, w from words where len(w) >= {LEAST}),
hashed as (select doc_id, pos, md5(array_to_string(w[pos + 1 : pos + {LEAST}], ' ')) as h from windows),
firsts as (select *, first_value(doc_id) over o as ref, first_value(pos) over o as ref_pos from hashed window o as (partition by h order by doc_id, pos rows between unbounded preceding and current row)),
dups as (select doc_id, pos, ref, ref_pos - pos as shift from firsts where (doc_id, pos) <> (ref, ref_pos)),
same as (
  select l.doc_id, l.ref, l.shift, a.pos, d.pos is not null as known
  from (select distinct doc_id, ref, shift from dups) l join hashed a on a.doc_id = l.doc_id join hashed b on b.doc_id = l.ref and b.pos = a.pos + l.shift and b.h = a.h
  left join dups d on d.doc_id = l.doc_id and d.ref = l.ref and d.shift = l.shift and d.pos = a.pos
), islands as (select *, pos - row_number() over (partition by doc_id, ref, shift order by pos) as g from same),
runs as (select doc_id, ref, shift, min(pos) as a, max(pos) + {LEAST} as e from islands group by doc_id, ref, shift, g having bool_or(known)),
parse as (
  select doc_id, a as s, e, ref, shift from runs qualify row_number() over (partition by doc_id order by a, e desc, ref, shift) = 1
  union all
  select doc_id, s, e, ref, shift from (
    select r.doc_id, greatest(p.e, min(r.a) over (partition by r.doc_id)) as s, r.a, r.e, r.ref, r.shift from parse p join runs r on r.doc_id = p.doc_id and r.e > p.e
  ) where a <= s qualify row_number() over (partition by doc_id order by e desc, ref, shift) = 1
)
select doc_id, s::bigint as start_word, e::bigint as end_word, ref as ref_doc_id, (s + shift)::bigint as ref_start_word from parse
"""
