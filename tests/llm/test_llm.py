"""The training-data operators: SQL agreement, brute force, and odd rows."""

import re
import time

import compare
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagewright.llm import _text as t
from pagewright.llm import _groups, bpe, chattree, langid, mixing, neardup, ngramjoin, queries, substring, topk, toxicity, urlfilter

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _goes int, chunk string"
WORDS = [f"w{i}" for i in range(400)]


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows and clashing column names."""
    long = prose(1, 60_000)
    rows = [(1, long), (2, long + " end"), (3, None), (4, ""), (None, long), (5, "one"), (6, "One."), (6, "One."), (7, " \n "), (8, prose(2, 80)), (9, prose(2, 80)), (10, prose(3, 80)), (10, prose(4, 80))]
    return spark.createDataFrame([(i, x, None if i == 5 else "en", None if i == 6 else "s", None if x is None else len(x), 1, "c") for i, x in rows], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    assert compare.differences(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], compare.duck(SF)) == ""


def test_odd_rows(spark):
    docs = odd(spark)
    n = docs.count()
    model = toxicity.train(["bad bad words here", "good clean words here"] * 20, [1, 0] * 20)
    scored = toxicity.score(docs, model).collect()
    assert len(scored) == n and all(r["toxic_score"] == 0 and not r["toxic"] for r in scored if r["doc_id"] in (3, 4, 7))
    assert toxicity.reject(docs, toxicity.train([], [])).count() == n
    assert langid.identify(docs, langid.fit(docs)).count() == n
    spans = substring.duplicate_spans(docs)
    assert {r["doc_id"] for r in spans.collect()} == {2, 9}
    kept = substring.remove_spans(docs, spans)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 6, 7, 8, 10, 10]
    one = ngramjoin.keep_one(docs)
    assert one.columns == docs.columns and sorted(r["doc_id"] or 0 for r in one.collect()) == [0, 1, 3, 4, 5, 7, 8, 10]
    tokens = bpe.tokenise(docs, keep=("doc_id", "text")).collect()
    assert len(tokens) == n and all(r["round_trip"] is not False for r in tokens) and [r["n_tokens"] for r in tokens if r["doc_id"] in (3, 4)] == [0, 0]
    assert mixing.mix(docs, {"s": 1.0, None: 1.0}, max_epochs=1.0).columns == [*docs.columns, "copy"]
    asked = spark.createDataFrame([(1, "w1 w2"), (2, None), (3, "zzz")], "item_id long, text string")
    assert {r["item_id"] for r in topk.search(docs, asked).collect()} == {1}


def test_empty_tables(spark):
    docs = odd(spark).limit(0)
    assert toxicity.reject(docs, toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0
    assert ngramjoin.keep_one(docs).count() == 0 and ngramjoin.classes(docs).count() == 0
    assert substring.remove_spans(docs, substring.duplicate_spans(docs)).count() == 0
    assert bpe.tokenise(docs).count() == 0
    assert langid.identify(docs, langid.fit(docs)).count() == 0
    assert neardup.classes(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert chattree.chat_tree(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_url_filter(spark):
    pages = spark.createDataFrame([(1, "HTTPS://www.A.com/x/?b=2&a=1&utm_source=q#t"), (2, "http://b.com/"), (3, None), (4, "")], "page_id long, url string")
    listed = spark.createDataFrame([("http://a.com/x?a=1&b=2",), (None,), ("",)], "url string")
    assert {r["page_id"]: r["listed"] for r in urlfilter.url_filter(pages, listed).collect()} == {1: True, 2: False, 3: False, 4: False}


def brute_classes(rows, n=2, threshold=0.7):
    """(doc_id, class, links, copies) by comparing everything with everything."""
    sets = {}
    for i, text in rows:
        w = text.lower().split()
        sets.setdefault(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]), []).append(i)
    keys = list(sets)
    links = {a: [b for b in keys if a is not b and len(a & b) >= threshold * len(a | b) - 1e-9] for a in keys}
    found, seen = {}, set()
    for a in keys:
        if a not in seen:
            group, todo = [], [a]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    group.append(x)
                    todo += links[x]
            least = min(i for x in group for i in sets[x])
            found |= {i: (i, least, len(links[x]), len(sets[x]) - 1) for x in group for i in sets[x]}
    return sorted(found.values())


def edited(seeds, size, share, rng):
    rows = []
    for i in range(seeds):
        words = prose(i // 3, size(i)).split()
        for j in np.flatnonzero(rng.random(len(words)) < share * (i % 4)):
            words[j] = "new" + str(rng.integers(1000))
        rows.append((i, " ".join(words)))
    return rows


def test_url_filter_beyond_the_broadcast_bound(spark):
    """A long list is joined by shuffle, with the same filter and the same rows; false positives of the filter are removed."""
    pages = spark.createDataFrame([(i % 4000, f"http://h{i % 4000}.com/p") for i in range(4400)] + [(5000, None), (5001, " ")], "page_id long, url string")
    listed = spark.createDataFrame([(f"http://h{i}.com/p",) for i in range(0, 4000, 2)] + [(None,), ("",)], "url string")
    small, large = (sorted((r.page_id, r.listed) for r in urlfilter.url_filter(pages, listed, most).collect()) for most in (1 << 20, 0))
    assert small == large and len(small) == 4402 and all(x == (i < 4000 and i % 2 == 0) for i, x in small)
    assert urlfilter.url_filter(pages.limit(0), listed).count() == 0 and urlfilter.url_filter(pages, listed.limit(0)).where("listed").count() == 0


@pytest.mark.parametrize("size", [lambda i: 2 + i // 9, lambda i: 1500 if i < 30 else 20 + i])
def test_join_against_brute_force(spark, size):
    rows = edited(300, size, 0.02, np.random.default_rng(5))
    want = brute_classes(rows)
    got = sorted(tuple(r) for r in ngramjoin.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == want and sum(x[2] + x[3] for x in want) > 50


def test_join_of_a_component_of_several_chunks(spark, monkeypatch):
    base, rows = prose(8, 100).split(), []
    for i in range(60):
        rows.append((i, " ".join([*base[:i], f"new{i}", *base[i + 1 :]])))
    docs = spark.createDataFrame([*rows, (60, rows[3][1]), (61, None), (62, "")], "doc_id long, text string")
    for name, most in (("BLOCK", 7), ("BLOCK_GRAMS", 900)):
        monkeypatch.setattr(ngramjoin, name, most)
        got = {r[0]: tuple(r)[1:] for r in ngramjoin.classes(docs).collect()}
        assert got == {i: (0, 59, int(i in (3, 60))) for i in range(61)} | {61: (61, 0, 0), 62: (62, 0, 0)}
        monkeypatch.undo()


def test_recall_of_signatures_by_size():
    """Two sets right at the threshold, the worst case, share a signature."""
    rng = np.random.default_rng(0)
    for n in (4, 6, 8, 10, 11, 12, 15, 18, 22, 30, 60, 150, 400, 3000):
        c, many, values, offsets = int(np.ceil(0.7 * n - 1e-9)), 400 if n < 200 else 40, [], [0]
        for _ in range(many):
            a = rng.integers(0, 1 << 63, n).astype(t.U)
            for x in (a, a[:c]):
                values.append(np.sort(x))
                offsets.append(offsets[-1] + len(x))
        owner, found = ngramjoin.signatures(np.concatenate(values), np.array(offsets), 0.7)
        sets = [set() for _ in range(2 * many)]
        for o, s in zip(owner.tolist(), found.tolist(), strict=True):
            sets[o].add(s)
        assert np.mean([bool(sets[2 * i] & sets[2 * i + 1]) for i in range(many)]) >= (0.98 if n < 60 else 1), n


def test_sets_of_every_size_share_a_signature():
    """All pairs right at the threshold, not most: one set within the other, or both with n-grams of their own."""
    rng = np.random.default_rng(3)
    for n in [*range(1, 41), 90, 250]:
        for own in {0, int(n * 0.15)}:
            c = int(np.ceil(0.7 * (n + own) - 1e-9))
            values, offsets = [], [0]
            for _ in range(300):
                a = rng.integers(0, 1 << 63, n + own).astype(t.U)
                for x in (a[:n], np.concatenate([a[:c], a[n:]])):
                    values.append(np.sort(x))
                    offsets.append(offsets[-1] + len(x))
            owner, found = ngramjoin.signatures(np.concatenate(values), np.array(offsets), 0.7)
            sets = [set() for _ in range(600)]
            for o, s in zip(owner.tolist(), found.tolist(), strict=True):
                sets[o].add(s)
            assert all(sets[2 * i] & sets[2 * i + 1] for i in range(300)), (n, own)


def test_every_pair_of_eleven_grams(spark):
    rows = []
    for i in range(1500):
        words = [f"p{i}x{j}" for j in range(12)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:9] if i % 3 else words[3:]))]
    assert ngramjoin.classes(spark.createDataFrame(rows, "doc_id long, text string")).where("n_links = 1").count() == 3000


def test_crowds_hang_together_as_their_pairs_do():
    rng = np.random.default_rng(6)
    sets = []
    for k in range(12):
        base = rng.integers(0, 1 << 63, 5 + 60 * k).astype(t.U)
        for _ in range(8):
            kept = rng.random(len(base)) < rng.choice([0.8, 0.95])
            sets.append(np.concatenate([base[:1], base[1:][kept[1:]], rng.integers(0, 1 << 63, rng.integers(1, 2 + len(base) // 10)).astype(t.U)]))
    order = rng.permutation(len(sets))
    sets = [sets[i] for i in order]
    size = np.array([len(x) for x in sets])
    offsets = np.concatenate([[0], np.cumsum(size)])
    data, start = ngramjoin.sketches(np.concatenate(sets), offsets)
    width = np.minimum(ngramjoin._width(size), ngramjoin.CROWD_WIDTH)
    rows = np.zeros((len(sets), ngramjoin.CROWD_WIDTH), t.U)
    for i, w in enumerate(width):
        rows[i, :w] = ngramjoin._at_width(data.view(t.U), start[i : i + 1] // 8, np.diff(start)[i : i + 1] // 8, w)[0]
    root = ngramjoin._crowd_roots(size, np.zeros(len(sets), int), rows.reshape(-1), np.arange(len(sets)) * ngramjoin.CROWD_WIDTH, 0.7)
    alike = 0
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both >= 0.7 * (size[i] + size[j] - both) - 1e-9:
                alike += 1
                assert root[i] == root[j]
    assert alike > 100 and len(np.unique(root)) >= 11


def test_long_sets_of_a_crowd_are_told_apart(spark):
    """Sketches of 512 bits used to link all sets of 800 n-grams that share a common one, into components whose blocks are copied for each other."""
    rng = np.random.default_rng(21)
    sets = [np.concatenate([np.array([7], t.U), rng.integers(0, 1 << 63, n).astype(t.U)]) for n in rng.integers(800, 1000, 60)]
    sets.append(np.concatenate([sets[0][:-20], rng.integers(0, 1 << 63, 20).astype(t.U)]))
    size = np.array([len(x) for x in sets])
    data, _ = ngramjoin.sketches(np.concatenate(sets), np.concatenate([[0], np.cumsum(size)]))
    rows = [(i, int(n), bytearray(x)) for i, (n, x) in enumerate(zip(size, data.reshape(len(sets), -1), strict=True))]
    known = spark.createDataFrame(rows, "set_hash long, weight int, sketch binary")
    met = spark.createDataFrame([(i, 7, 0, None, None) for i in range(len(sets))], "a long, b long, at int, times int, least int")
    assert {tuple(sorted(r)) for r in ngramjoin._links(met, known, 0.7).collect()} == {(0, 60)}


def test_sets_that_share_few_signatures_are_not_paired(spark):
    """Long sets that meet once by chance used to be joined with their sketches; similar ones meet as often as their sizes ask for."""
    rng = np.random.default_rng(22)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, n))
    rows = [(i, f"{words(150)} both of them {words(150)}") for i in range(20)]
    near = words(300).split()
    rows += [(20, " ".join(near)), (21, " ".join(near[:-50] + words(50).split()))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    met = ngramjoin._meetings(docs, np.zeros((1 << ngramjoin.PLACE_BITS) + 1, np.int8), 2, 0.7)
    often = met.groupBy("a", "b").agg(F.sum("times").alias("times"), F.max("least").alias("least"))
    assert often.where("times >= least").count() == 1 and often.where("least < 4").count() == 0
    assert {r[0]: r[1] for r in ngramjoin.classes(docs).where("n_links > 0").select("doc_id", "class_id").collect()} == {20: 20, 21: 20}


def test_signatures_shared_by_sets_of_every_size():
    """Pairs right at the threshold share as many of the first as are asked for, at places that may meet."""
    rng = np.random.default_rng(23)
    for n in [*range(1, 41), 90, 130, 250, 700]:
        for own in {0, int(n * 0.08), int(n * 0.15)}:
            c = int(np.ceil(0.7 * (n + own) - 1e-9))
            if c > n:
                continue
            for _ in range(40):
                a = rng.integers(0, 1 << 63, n + own).astype(t.U)
                x, y = np.sort(a[:n]), np.sort(np.concatenate([a[:c], a[n:]]))
                size = np.array([len(x), len(y)])
                first = np.bincount(ngramjoin._first(np.concatenate([[0], np.cumsum(size)]), 0.7, ngramjoin._shared(size))[0])
                _, i, j = np.intersect1d(x[: first[0]], y[: first[1]], return_indices=True)
                met = ngramjoin._may_meet(size[:1], i, size[1:], j, 0.7).sum()
                assert met >= min(ngramjoin._shared(size).min(), ngramjoin._least(*size, 0.7)), (n, own)


def test_unlike_texts_of_common_words_are_not_compared(spark):
    """What they have in common grows with their number; sets that only share common n-grams used to hang together."""
    rng = np.random.default_rng(11)
    rows = [(i, " ".join(f"s{rng.integers(25)}" if rng.random() < 0.6 else f"u{rng.integers(100000)}" for _ in range(60))) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert ngramjoin._blocks(docs, ngramjoin._named(docs, 2), 2, 0.7).count() == 0


def test_components_take_few_jobs(spark, monkeypatch):
    """In one task or in rounds, the same roots; the rounds' many jobs used to fill the driver's memory."""
    rng = np.random.default_rng(9)
    chain = rng.permutation(60)
    rows = [*zip(chain[:-1].tolist(), chain[1:].tolist(), strict=True), (-5, 1000), (1000, 2000), (2000, 2000), (3000, None), (7000, 6000)]
    edges = spark.createDataFrame(rows, "a long, b long")
    want = {i: 0 for i in range(60)} | {-5: -5, 1000: -5, 2000: -5, 6000: 6000, 7000: 6000}
    jobs = []
    for most in (500_000, 20):
        monkeypatch.setattr(_groups, "ONE_TASK", most)
        spark.sparkContext.setJobGroup(f"components {most}", "")
        assert {r.id: r.root for r in _groups.components(edges).collect()} == want
        assert _groups.components(edges.where("a = b")).count() == 0
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components {most}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] < jobs[1] / 2, jobs


def test_signatures_shuffled_go_before_sets_are_linked(spark, monkeypatch):
    """Their files are larger than the documents; they used to stay until the driver collected its garbage."""

    def files():
        return set(re.findall(r"shuffle_(\d+)_", str(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" "))))

    signatures, left, links, stored = [], [], ngramjoin._links, ngramjoin.stored

    def keep(df):
        table = stored(df)
        signatures.append(max(files(), key=int, default=None))
        return table

    def late(*given):
        for _ in range(50):
            left.append(signatures[-1] in files())
            if not left[-1]:
                break
            time.sleep(0.1)
        return links(*given)

    monkeypatch.setattr(ngramjoin, "stored", keep)
    monkeypatch.setattr(ngramjoin, "_links", late)
    rows = edited(200, lambda i: 60, 0.02, np.random.default_rng(5))
    assert ngramjoin.classes(spark.createDataFrame(rows, "doc_id long, text string")).count() == len(rows)
    assert left and not left[-1]


def test_near_vectors_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 64))
    hot = base[0] + rng.normal(size=(50, 64)) * 0.05
    near = np.concatenate([base, base + rng.normal(size=base.shape) * rng.uniform(0.05, 0.3, (150, 1)), hot, base[:20]]).astype(np.float32)
    unit = near.astype(np.float64) / np.linalg.norm(near.astype(np.float64), axis=1, keepdims=True)
    different = (near[:, None] != near[None]).any(axis=2)
    linked = (unit @ unit.T >= 0.95) & different
    first = [int(np.flatnonzero(~d)[0]) for d in different]
    reach = linked | ~different
    for _ in range(8):
        reach = (reach.astype(np.int32) @ reach) > 0
    want = {i: (int(np.flatnonzero(reach[i])[0]), len({first[j] for j in np.flatnonzero(linked[i])}), int((~different[i]).sum()) - 1) for i in range(len(near))}
    rows = [(i, v.tolist()) for i, v in enumerate(near)] + [(900, None), (901, []), (902, [0.0] * 64), (903, [float("nan")] * 64), (None, near[0].tolist()), (904, near[0].tolist()[:32]), (5, None)]
    want |= {i: (i, 0, 0) for i in range(900, 905)}
    for most in (2000, 9):
        monkeypatch.setattr(neardup, "BLOCK", most)
        vectors = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, id int")
        got = {r[0]: tuple(r)[1:] for r in neardup.classes(vectors).collect()}
        assert got == want and sum(x[1] for x in want.values()) > 2000


def test_estimates_are_unbiased():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 64))
    a, b = a / np.linalg.norm(a), b / np.linalg.norm(b)
    found = []
    for seed in range(300):
        turn = neardup.rotation(64, seed=seed)
        code, factor = neardup.encode(a[None], turn)
        found.append(float(neardup.estimates(code, factor, b[None] @ turn)[0]))
        assert abs(found[-1] - a @ b) < 3 * neardup.bounds(factor, turn.shape[1])[0]
    assert abs(np.mean(found) - a @ b) < 0.01


def test_windows_that_share_32_bits_are_not_duplicates(spark):
    texts = [" ".join([*(f"w{i}" for i in range(49)), end]) for end in ("x112959", "x281079")]
    hashes = []
    for text in texts:
        cps, _ = t.code_points(pa.array([text]))
        hashes.append(t.window_hashes(t.word_hashes(cps, *t.runs(t.is_solid(cps))), 50)[0])
    assert hashes[0] >> t.U(32) == hashes[1] >> t.U(32) and hashes[0] != hashes[1]
    docs = spark.createDataFrame([*enumerate(texts), (2, texts[0])], "doc_id long, text string")
    assert [(r["doc_id"], r["ref_doc_id"]) for r in substring.duplicate_spans(docs).collect()] == [(2, 0)]


def brute_parse(texts, least=50):
    """Factors by comparing words with words; ids are places in the list."""
    words = [x.split() for x in texts]
    first = {}
    for d, w in enumerate(words):
        for p in range(len(w) - least + 1):
            first.setdefault(tuple(w[p : p + least]), (d, p))
    found = []
    for d, w in enumerate(words):
        lines = {}
        for p in range(len(w) - least + 1):
            r, q = first[tuple(w[p : p + least])]
            if (r, q) != (d, p):
                lines.setdefault((r, q - p), p)
        runs = set()
        for p in range(len(w) - least + 1):
            r, q = first[tuple(w[p : p + least])]
            if (r, q) != (d, p):
                a, b = p, p + least
                while a > 0 and q - p + a > 0 and w[a - 1] == words[r][q - p + a - 1]:
                    a -= 1
                while b < len(w) and q - p + b < len(words[r]) and w[b] == words[r][q - p + b]:
                    b += 1
                runs.add((a, b, r, q - p))
        at = 0
        while at < len(w):
            cover = [(-b, r, shift) for a, b, r, shift in runs if a <= at < b]
            if not cover:
                at += 1
                continue
            b, r, shift = min(cover)
            found.append((d, at, -b, r, at + shift))
            at = -b
    return found


@pytest.mark.parametrize("hot", [10_000, 3])
def test_parse_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    p, q = prose(21, 100).split(), prose(22, 60).split()
    both = " ".join([*p[40:], *q])
    texts = [" ".join(p), both, both, prose(5, 49), "", " ".join([*prose(6, 50).split()] * 3), "for " * 300, "x y " + "for " * 200 + "z"]
    rng = np.random.default_rng(2)
    pool = [prose(40 + i, 130).split() for i in range(4)]
    for i in range(60):
        parts = [prose(100 + i, 20)]
        for _ in range(int(rng.integers(1, 5))):
            x, a, n = pool[int(rng.integers(4))], int(rng.integers(0, 60)), int(rng.integers(40, 130))
            parts.append(" ".join(x[a : a + n]))
        texts.append(" ".join(parts))
    docs = spark.createDataFrame([*enumerate(texts), (2, both)], "doc_id long, text string")
    got = sorted((r.doc_id, r.start_word, r.end_word, r.ref_doc_id, r.ref_start_word) for r in substring.duplicate_spans(docs).collect())
    assert got == sorted(brute_parse(texts)) and (2, 0, 120, 1, 0) in got and len(got) > 60


def test_water_filling():
    given = mixing.water_fill({"a": 10, "b": 100, "c": 0}, {"a": 5, "b": 1}, 110, 2)
    assert given["a"] == 2 and abs(given["b"] * 100 + 20 - 110) < 1e-9 and given["c"] == 0


def test_byte_pair_against_tiktoken():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    other = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.Codec(bpe.serialise(bpe.read_vocabulary()))
    for text in ["Hello  world!\n\n it's é漢字 🙂", "a" * 500, "<|endoftext|>", "\x00\x7f \t", prose(9, 300)]:
        assert own.encode(text).tolist() == other.encode_ordinary(text) and own.decode(own.encode(text)) == text


def test_toxicity_of_each_row_is_its_own():
    rng = np.random.default_rng(4)
    model = toxicity.Model(rng.normal(size=1 << toxicity.BITS).astype(np.float32), 0.5, 0.0)
    insult = "you stupid worthless pathetic idiot just get lost"
    texts = [insult, insult, insult, prose(1, 60), insult + " now", insult, "", None, insult, prose(1, 60), prose(1, 60)]
    alone = [toxicity.score_batch(pa.array([x], pa.string()), model)[0] for x in texts]
    assert np.allclose(toxicity.score_batch(pa.array(texts), model), alone, atol=1e-9) and alone[0] != 0.5


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    known = labels.where("pmod(xxhash64(doc_id), 2) = 0")
    rest = labels.where("pmod(xxhash64(doc_id), 2) = 1").withColumnRenamed("toxic", "label")
    said = toxicity.score(docs, toxicity.fit(docs, known)).join(rest, "doc_id").groupBy("label").agg(F.avg(F.col("toxic").cast("int")).alias("share"))
    caught = {r["label"]: r["share"] for r in said.collect()}
    assert caught[1] > 0.9 and caught[0] < 0.05, caught


def test_toxicity_of_misspellings_never_seen(spark):
    """Character n-grams of known insults give away spellings that training hasn't seen."""
    insults = ["worthless", "pathetic", "disgusting", "stupid"]
    texts, toxic = [], []
    for i in range(240):
        words = prose(i, 40).split()
        if i % 2:
            words[i % 40], words[(i * 7) % 40] = insults[i % 4], insults[(i // 2) % 4]
        texts.append(" ".join(words))
        toxic.append(i % 2)
    model = toxicity.train(texts, toxic)
    new = {"worthlesss": 1, "patheticc": 1, "disgustingg": 1, "disgustingly": 1, "w9999": 0, "garden": 0, "harbour": 0}
    docs = spark.createDataFrame([(i, " ".join([*prose(900 + i, 15).split(), w, *prose(950 + i, 15).split(), w])) for i, w in enumerate(new)], "doc_id long, text string")
    got = {r["doc_id"]: r["toxic"] for r in toxicity.score(docs, model).collect()}
    assert [got[i] for i in range(len(new))] == [bool(x) for x in new.values()]


def test_toxicity_score_against_one_word_at_a_time():
    """The batch scorer gives what averaging passage by passage gives."""
    model = toxicity.Model(np.random.default_rng(8).normal(size=1 << toxicity.BITS).astype(np.float32), 0.25, 0.0)
    for text in [prose(3, 5), prose(4, 100), "a a a b b b " * 20]:
        (ids, at, before), = toxicity._bags([text])
        n, best = len(at) - 1, -np.inf
        for first in sorted({min(s, max(n - toxicity.PASSAGE, 0)) for s in range(0, n, toxicity.STEP)}):
            end = min(first + toxicity.PASSAGE, n)
            best = max(best, sum(float(model.score[b]) for b in ids[at[first] : at[end]]) / max(before[end] - before[first], toxicity.LEAST))
        assert abs(toxicity.score_batch(pa.array([text]), model)[0] - best - model.bias) < 1e-3


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs.where("pmod(xxhash64(doc_id), 2) = 0"))
    test = docs.where("pmod(xxhash64(doc_id), 2) = 1")
    right = langid.identify(test, model).join(test.select("doc_id", "lang"), "doc_id").agg(F.avg((F.col("language") == F.col("lang")).cast("int"))).first()[0]
    assert right > 0.9


def test_mixing_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "aaaa", "x", 9), (2, "bb", "y", 8), (2, "bb", "y", 8), (3, None, "y", 7), (4, "c" * 50, None, 6), (5, "", "z", 5)], "doc_id long, text string, source string, copy int")
    got = mixing.mix(docs, {"x": 100.0, "y": 0.0, None: 1.0}, max_epochs=2.0)
    assert sorted((r.doc_id, r.copy) for r in got.collect()) == [(1, 0), (1, 1), *((4, i) for i in range(1))] and got.columns == ["doc_id", "text", "source", "copy"]
    assert {r.copy for r in mixing.mix(docs, {}, number="n").select("copy").collect()} <= {9, 8, 7, 6} and mixing.mix(docs.limit(0), {}).count() == 0


@pytest.mark.parametrize("weights", [{"s0": 5.0, "s1": 0.5}, {}])
def test_many_sources_like_few(spark, monkeypatch, weights):
    docs = spark.createDataFrame([(i, "x" * (1 + i % 37), f"s{i % 11}") for i in range(400)], "doc_id long, text string, source string")
    few = {r.source: r.epochs for r in mixing.rates(docs, weights, 1.5, 2.0).collect()}
    monkeypatch.setattr(mixing, "MAX_BROADCAST", 3)
    many = {r.source: r.epochs for r in mixing.rates(docs, weights, 1.5, 2.0).collect()}
    assert few.keys() == many.keys() and all(abs(few[s] - many[s]) < 1e-9 for s in few)


def test_pipeline_of_odd_rows(spark):
    docs = odd(spark).withColumn("copy", F.lit(5))
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, SF)
        assert at.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    assert {r["copy"] for r in at.select("copy").collect()} == {5}
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, at, SF).where("not round_trip").count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        was, at = at, stage(spark, at, SF).cache()
        assert at.columns == docs.columns, name
        assert at.count() <= was.count() or name == "mixing sources"
    out = corpus_pipeline.run(spark, SF)
    assert out.count() == at.count() and out.where("not round_trip").count() == 0
