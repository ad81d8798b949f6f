"""Character n-gram features of words, as bucket numbers.

Words are runs of letters and digits in lower case. An n-gram lies in one
word and may take in one boundary mark before and after it. With whole words
as features too, two equal words always have equal features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from pagewright.llm import _text as t

_STEP = t.U(0x9E3779B97F4A7C15)


def _grams(cps: np.ndarray, sizes: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Starts and ends of words, and for each size (first positions, buckets)."""
    low = t.lowered(cps)
    word = t.is_word(low)
    if len(word):
        word[-1] = False  # always the newline that ends a text
    starts, ends = t.runs(word)
    code = np.where(word, low.astype(t.U) + t.U(1), t.U(0))
    code = (code * t.U(0xBF58476D1CE4E5B9)) ^ (code << t.U(17))

    def each() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        h, inner = code, np.ones(len(code), dtype=bool)
        for n in range(1, max(sizes) + 1):
            if n > 1:
                m = len(code) - n + 1
                if m <= 0:
                    return
                h = h[:m] * _STEP + code[n - 1 :]
                inner = (inner[:m] & word[n - 2 : n - 2 + m]) if n > 2 else np.ones(m, dtype=bool)
            if n in sizes:
                ok = word if n == 1 else (word[: len(h)] | word[1 : len(h) + 1]) if n == 2 else inner
                at = np.flatnonzero(ok)
                yield at, ((h[at] ^ (h[at] >> t.U(29))) * t.U(0x94D049BB133111EB) >> t.U(64 - bits)).astype(np.int32)

    return starts, ends, low, each()


def _wholes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    hashes = t.mix(t.word_hashes(low, starts, ends) + t.U(77))
    return hashes, (hashes >> t.U(64 - bits)).astype(np.int32)


def fresh(hashes: np.ndarray, text: np.ndarray, within: int) -> np.ndarray:
    """Whether none of the ``within`` - 1 words before is the same word of the same text; ``text`` numbers each word's."""
    order = np.argsort(hashes, kind="stable")
    # of equal words the one just before is the nearest: if that is of another text, so are all others
    again = (hashes[order][1:] == hashes[order][:-1]) & (text[order][1:] == text[order][:-1]) & (np.diff(order) < within)
    new = np.ones(len(hashes), dtype=bool)
    new[order[1:][again]] = False
    return new


def subwords(cps: np.ndarray, sizes: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, number of its word) of each feature; the words' starts and hashes."""
    starts, ends, low, each = _grams(cps, sizes, bits)
    hashes, whole = _wholes(low, starts, ends, bits)
    buckets, owners = [whole], [np.arange(len(starts))]
    for at, bucket in each:
        # an n-gram belongs to the word that starts at it or one place after it, or that holds it
        buckets.append(bucket)
        owners.append(np.searchsorted(starts, at + 1, side="right") - 1)
    return np.concatenate(buckets), np.concatenate(owners), starts, hashes


def summed(cps: np.ndarray, table: np.ndarray, sizes: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: the sum of its features' entries of ``table`` (one or more columns), their number, its start and its hash."""
    starts, ends, low, each = _grams(cps, sizes, bits)
    hashes, whole = _wholes(low, starts, ends, bits)
    if not len(starts):
        return np.zeros((0, *table.shape[1:])), np.zeros(0), starts, hashes
    sums = np.zeros((len(cps) + 1, *table.shape[1:]), np.float32)
    counts = np.zeros(len(cps) + 1, np.int32)
    for at, bucket in each:
        sums[at] += table[bucket]
        counts[at] += 1
    sums[starts] += table[whole]
    counts[starts] += 1
    # the features of a word start between the place before it and its end
    edge = np.concatenate([np.maximum(starts - 1, 0), [len(cps)]])
    return np.add.reduceat(sums, edge, axis=0, dtype=np.float64)[:-1], np.add.reduceat(counts, edge, dtype=np.int64)[:-1], starts, hashes
