"""Periodic runs of words: an online DP over sparse diagonals, and texts with every run collapsed to its first period."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairfold.llm.text import rows_of, space_words

MIN_LENGTH, MIN_REPEATS = 24, 3
TOGETHER = 200_000  # words of short documents that are looked at in one go
SCHEMA = (
    "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, start long, length long, period long, kept_text string"
)
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", _RUNS), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("kept_text", pa.string()),
])


def repeated_tail(doc_id: Column, text: Column) -> Column:
    """Texts of which a tenth, chosen by crc32 of the decimal doc_id, repeat a passage to their end; the others unchanged.

    With h the checksum, g = h div 10 and n words, h % 10 = 0 makes word i from a = g % n on the word
    a + (i - a) % p, where p = 1 + (n - a) div (3 + g % 8).  A NULL doc_id or a text without words changes nothing.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    g = F.floor(h / 10).cast("long")

    def changed(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8)))).cast("long")
        order = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int"))
        return F.array_join(F.transform(order, lambda i: F.get(w, i)), " ")

    # one lambda call binds the words once
    return F.when((h % 10 == 0) & F.exists(words, lambda w: F.lit(True)), F.element_at(F.transform(F.array(words), changed), 1)).otherwise(text)


def _sparse_matches(ids: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For widths ``least``, 2 * least, ...: places whose run of ``width`` words occurred before, and the lag to its latest occurrence.

    ``ids`` number the words of several documents, no number in two of them.  A wider run can only occur
    again where both its halves do, so the places that take part become fewer with every doubling.
    """
    width, number = 1, np.where(np.bincount(ids)[ids] > 1, ids, -1)
    while True:
        if width >= least:
            at = np.flatnonzero(number >= 0)
            order = np.argsort(number[at], kind="stable")
            same = number[at[order[1:]]] == number[at[order[:-1]]]
            here, before = at[order[1:]][same], at[order[:-1]][same]
            by = np.argsort(here)
            yield width, here[by], (here - before)[by]
        at = np.flatnonzero((number[:-width] >= 0) & (number[width:] >= 0)) if width < len(number) else np.empty(0, np.int64)
        if not len(at):
            return
        _, inverse, counts = np.unique(number[at] * np.int64(number.max() + 1) + number[at + width], return_inverse=True, return_counts=True)
        number = np.full(len(number), -1)
        number[at] = np.where(counts[inverse] > 1, inverse, -1)
        width *= 2


def find_runs(ids: np.ndarray, min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS) -> list[tuple[int, int, int]]:
    """All (start, length, period) of the word numbers ``ids``, by start and period.

    Words are read in order; an earlier occurrence at lag q lengthens the match on diagonal q, and when a
    diagonal ends, its match of m words is a run of m + q words if that is long enough.  Frequent words
    have many earlier occurrences of which almost all end at once.  So a word counts as occurring earlier
    only together with the words after it: every run matches at least as many words as the smallest of
    max(min_length - q, (min_repeats - 1) * q) over all q (16 for 24 and 3), and at least 2 * q.  With a width of
    at least q and at most that, the latest occurrence alone is on the run's diagonal: a nearer one would
    give the run a smaller period.  So lags up to the first width, then lags of (width / 2, width] for every
    doubled width, are followed, one diagonal a width at a time, and what ends is exactly the runs.
    """
    if min_repeats < 3 or min_length < 1:
        raise ValueError("runs need three repeats and one word at least")
    shortest = min(max(min_length - q, (min_repeats - 1) * q) for q in range(1, min_length + 1))
    least = 1 << (shortest.bit_length() - 1)
    runs = []
    for width, places, lags in _sparse_matches(ids, least):
        near = (lags <= width) & ((lags > width // 2) | (width == least))
        lag, begun, last = 0, 0, -2  # the active diagonal, where its match began, and the place it has reached
        for at, q in zip([*places[near].tolist(), -1], [*lags[near].tolist(), 0], strict=True):
            if at == last + 1 and q == lag:
                last = at
                continue
            length = last - begun + width + lag
            if lag and length >= max(min_length, min_repeats * lag):
                runs.append((begun - lag, length, lag))
            lag, begun, last = q, at, at
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run holds behind its first period."""
    if not runs:
        return b" ".join(words).decode()
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()).decode()


def _answers(docs: list[tuple], min_length: int, min_repeats: int) -> pa.RecordBatch:
    ids, begins = [], []
    for _, words in docs:
        begins.append(len(ids))
        own: dict[bytes, int] = {}
        base, number = len(ids), own.setdefault
        ids.extend([number(w, base + len(own)) for w in words])
    found: list[list] = [[] for _ in docs]
    if ids:
        runs = find_runs(np.array(ids), min_length, min_repeats)
        of = np.searchsorted(begins, [r[0] for r in runs], "right") - 1
        for k, (start, length, period) in zip(of.tolist(), runs, strict=True):
            found[k].append((start - begins[k], length, period))
    out = []
    for (doc_id, words), runs in zip(docs, found, strict=True):
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        out.append((doc_id, len(words), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], *best, _collapsed(words, runs)))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS) -> DataFrame:
    """One row per document: doc_id, n_words, runs, the strongest run's start, length and period, kept_text.

    A run is a stretch of words with smallest period q, of at least ``min_length`` words and ``min_repeats``
    periods, that no neighbouring word extends.  The strongest run has the greatest length / period, then the
    smallest start, then the smallest period; without a run the three columns are NULL.  ``kept_text`` holds
    the words that lie in no run behind its first q words, joined by one space.

    Words are ``[^\\x20\\x09-\\x0D]+``.  A NULL text has no words, as an empty one; a NULL doc_id is an id like
    any other.  Repeated rows give repeated answers, an empty table none; further columns are ignored.
    Texts are read one by one, in time and memory that grow with their words (times the logarithm of the
    longest run), whatever they repeat.  Nothing is shuffled.
    """

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for doc_id, text in rows_of(batches):
            waiting.append((doc_id, space_words(text or b"")))
            size += len(waiting[-1][1]) + 20
            if size >= TOGETHER:
                yield _answers(waiting, min_length, min_repeats)
                waiting, size = [], 0
        if waiting:
            yield _answers(waiting, min_length, min_repeats)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(task, SCHEMA)
