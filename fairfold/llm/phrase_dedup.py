"""Repeated passages: recurring word windows, compiled into sharded Aho-Corasick automata, removed from later documents."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairfold.llm.text import (
    matching, plain_text, rows_of, run_id, shuffle_partitions, space_words, starts_of_runs, stored, window_hashes, word_hashes,
)

WINDOW = 13
CHUNK = 1_500_000  # windows a task packs at a time
SPAN = 60_000  # words of one document that a packed row numbers; longer documents continue in the next
FP_BYTES = 7  # bytes of a window's hash that are sent, beside the bucket number
MAX_SHARDS = 65_000

_PACKED = "key long, chunk long, at binary, a binary, b binary, c binary"
_RUNS = "doc_id long, row long, own boolean, shard int, start int, count int"
_PROFILE = "doc_id long, row long, n_words long, whole_sha256 string"


def _runs(own, shard, doc, pos) -> tuple[np.ndarray, ...]:
    """Merge window starts into runs of consecutive ones with one owner shard: own, shard, doc, start, count."""
    order = np.lexsort((pos, shard, doc, own))
    own, shard, doc, pos = own[order], shard[order], doc[order], pos[order]
    new = np.ones(len(pos), bool)
    new[1:] = (own[1:] != own[:-1]) | (shard[1:] != shard[:-1]) | (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1)
    first = np.flatnonzero(new)
    return own[first], shard[first], doc[first], pos[first], np.diff(np.append(first, len(pos)))


def _shard_of(ids: np.ndarray, shards: int) -> np.ndarray:
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(32)) % np.uint64(shards)).astype(np.uint16)


def _pack(width: int, buckets: int, shards: int):
    """Deal the windows of a run of documents out to hash buckets.

    Of equal windows in one run of documents only those of the first document (smallest doc_id) are sent;
    the others recur for certain, and that document is their owner.  So a window held by a third of all rows reaches its
    bucket once a run.  Packed rows: window hashes, piece numbers, positions within the piece; a piece
    is a document or SPAN words of it.
    """

    def pack(batches: Iterable[pa.RecordBatch]):
        docs: list[tuple] = []
        size = 0

        def flush(number):
            docs.sort(key=lambda d: d[:2])
            pieces = [(i, s) for i, d in enumerate(docs) for s in range(0, max(1, len(d[3])), SPAN)]
            of = np.array([p[0] for p in pieces], np.int64)
            base = np.array([p[1] for p in pieces], np.int64)
            ids = np.array([d[0] for d in docs], np.int64)[of]
            rows = np.array([d[1] for d in docs], np.int64)[of]
            parts = [docs[i][3][s : s + SPAN] for i, s in pieces]
            n = [len(p) for p in parts]
            h = np.concatenate(parts)
            piece = np.repeat(np.arange(len(pieces)).astype(np.uint16), n)
            pos = np.concatenate([np.arange(k, dtype=np.uint16) for k in n])
            order = np.argsort(h, kind="stable")
            h, piece, pos = h[order], piece[order], pos[order]
            first = starts_of_runs(h)
            lead = np.flatnonzero(first)[np.cumsum(first) - 1] if len(h) else np.empty(0, np.int64)
            later = ids[piece] > ids[piece[lead]]
            owner = np.unique(lead[later])
            local = (
                np.concatenate((np.ones(len(owner), bool), np.zeros(int(later.sum()), bool))),
                _shard_of(ids[piece[np.concatenate((owner, lead[later]))]], shards),
                np.concatenate((piece[owner], piece[later])), np.concatenate((pos[owner], pos[later])),
            )
            head = zlib.compress(np.diff(ids, prepend=0).tobytes() + np.diff(rows, prepend=0).tobytes() + np.diff(base, prepend=0).tobytes(), 1)
            chunk = run_id(number, head)
            profile = np.array([d[0] for d in docs], np.int64).tobytes() + np.array([d[1] for d in docs], np.int64).tobytes() + np.array([d[2] for d in docs], np.int64).tobytes()
            out = [(-1 - chunk % buckets, chunk, head, zlib.compress(b"".join(np.ascontiguousarray(x).tobytes() for x in local), 1), profile, b"".join(d[4] for d in docs))]
            kept = ~later  # the first document's own repeats of a window stand or fall with it
            h, piece, pos = h[kept], piece[kept], pos[kept]
            edge = np.searchsorted(((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64), np.arange(buckets + 1))
            sent = h.view(np.uint8).reshape(-1, 8)[:, :FP_BYTES]
            for b in range(buckets):
                lo, hi = edge[b], edge[b + 1]
                if lo < hi:
                    out.append((b, chunk, head, sent[lo:hi].tobytes(), piece[lo:hi].tobytes(), pos[lo:hi].tobytes()))
            docs.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64())] + [pa.array([r[j] for r in out], pa.binary()) for j in (2, 3, 4, 5)],
                ["key", "chunk", "at", "a", "b", "c"],
            )

        pieces = number = 0
        for doc_id, row, text in rows_of(batches):
            words = space_words(text)
            whole = hashlib.sha256(b" ".join(words)).digest()
            docs.append((doc_id, row, len(words), window_hashes(word_hashes(words), width), whole))
            size += len(words)
            pieces += 1 + len(words) // SPAN
            if size >= CHUNK or pieces >= 60_000:
                yield flush(number)
                number += 1
                size = pieces = 0
        if docs:
            yield flush(number)

    return pack


def _head(packed: bytes) -> np.ndarray:
    """doc_ids, row hashes and bases of a run's pieces."""
    return np.cumsum(np.frombuffer(zlib.decompress(packed), np.int64).reshape(3, -1), axis=1)


def _recurring(shards: int):
    """In one bucket: windows that also start in a document with a smaller doc_id, and the windows that own them."""

    def recurring(table: pa.Table) -> pa.Table:
        keys = table["key"].to_pylist()
        chunk, at, a, b, c = (table[n].to_pylist() for n in ("chunk", "at", "a", "b", "c"))
        if keys[0] < 0:
            return table
        count = [len(x) // 2 for x in b]
        run = np.repeat(np.arange(len(a), dtype=np.uint32), count)
        piece = np.concatenate([np.frombuffer(x, np.uint16) for x in b])
        pos = np.concatenate([np.frombuffer(x, np.uint16) for x in c])
        h = np.zeros((len(run), 8), np.uint8)
        h[:, :FP_BYTES] = np.frombuffer(b"".join(a), np.uint8).reshape(-1, FP_BYTES)
        h = h.view(np.uint64).ravel()
        # only windows that several runs hold are looked at closer
        order = np.argsort(h, kind="stable")
        first = starts_of_runs(h[order])
        same = np.cumsum(first) - 1
        order = order[(np.bincount(same) > 1)[same]] if len(h) else order
        h, run, piece, pos = h[order], run[order], piece[order], pos[order]
        ids = np.empty(len(h), np.int64)
        by_run = np.argsort(run, kind="stable")
        edges = np.searchsorted(run[by_run], np.arange(len(a) + 1))
        for r in range(len(a)):
            here = by_run[edges[r] : edges[r + 1]]
            if len(here):
                ids[here] = _head(at[r])[0][piece[here]]
        order = np.lexsort((ids, h))
        h, run, piece, pos, ids = h[order], run[order], piece[order], pos[order], ids[order]
        first = starts_of_runs(h)
        lead = np.flatnonzero(first)[np.cumsum(first) - 1] if len(h) else np.empty(0, np.int64)
        later = ids > ids[lead]
        owner = np.unique(lead[later])
        which = np.concatenate((owner, np.flatnonzero(later)))
        own = np.concatenate((np.ones(len(owner), bool), np.zeros(int(later.sum()), bool)))
        shard = _shard_of(ids[np.concatenate((owner, lead[later]))], shards)
        order = np.argsort(run[which], kind="stable")
        which, own, shard = which[order], own[order], shard[order]
        edges = np.searchsorted(run[which], np.arange(len(a) + 1))
        out = []
        for r in range(len(a)):
            lo, hi = edges[r], edges[r + 1]
            if lo < hi:
                parts = own[lo:hi], shard[lo:hi], piece[which[lo:hi]], pos[which[lo:hi]]
                out.append((keys[r], chunk[r], b"", zlib.compress(b"".join(np.ascontiguousarray(x).tobytes() for x in parts), 1), b"", b""))
        return pa.table(
            [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())] + [pa.array([x[j] for x in out], pa.binary()) for j in (2, 3, 4, 5)],
            ["key", "chunk", "at", "a", "b", "c"],
        )

    return recurring


def _gather(table: pa.Table) -> pa.Table:
    """A run's answers joined again: its recurring windows as runs, and a row (own NULL) for each document."""
    head, a, b, c = (table[n].to_pylist() for n in ("at", "a", "b", "c"))
    heads = [i for i, x in enumerate(head) if x]
    ids, rows, base = _head(head[heads[0]])
    parts = [[], [], [], []]
    for x in a:
        raw = zlib.decompress(x)
        n = len(raw) // 7
        for part, (lo, hi, kind) in zip(parts, ((0, n, bool), (n, 3 * n, np.uint16), (3 * n, 5 * n, np.uint16), (5 * n, 7 * n, np.uint16)), strict=True):
            part.append(np.frombuffer(raw[lo:hi], kind))
    own, shard, piece, pos = (np.concatenate(p) for p in parts)
    own, shard, piece, pos, count = _runs(own, shard, piece, pos.astype(np.int64))
    docs, hashes, n_words = np.frombuffer(b[heads[0]], np.int64).reshape(3, -1)
    k, d = len(own), len(docs)
    none = [None] * k
    whole = c[heads[0]]
    return pa.table(
        [
            pa.array(np.concatenate((ids[piece], docs))), pa.array(np.concatenate((rows[piece], hashes))),
            pa.array(own.tolist() + [None] * d, pa.bool_()), pa.array(shard.tolist() + [None] * d, pa.int32()),
            pa.array((base[piece] + pos).tolist() + [None] * d, pa.int32()), pa.array(count.tolist() + [None] * d, pa.int32()),
            pa.array(none + n_words.tolist(), pa.int64()), pa.array(none + [whole[32 * i : 32 * i + 32].hex() for i in range(d)], pa.string()),
        ],
        ["doc_id", "row", "own", "shard", "start", "count", "n_words", "whole_sha256"],
    )


def _cut(width: int):
    """The words of the runs of one document each: what goes to a shard's automaton or through it."""

    def cut(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for doc_id, row, text, runs in rows_of([batch]):
                words = space_words(text)
                for r in runs:
                    piece = b" ".join(words[r["start"] : r["start"] + r["count"] + width - 1])
                    out.append((r["shard"], doc_id, row, r["own"], r["start"], piece))
                    size += len(piece)
                if size > 8_000_000:
                    yield _cuts(out)
                    out, size = [], 0
            if out:
                yield _cuts(out)

    return cut


def _cuts(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], k) for j, k in enumerate(kinds)], ["shard", "doc_id", "row", "own", "start", "words"])


def _locate(width: int):
    """Shard by shard: compile the passages that come first, stream the texts that follow through the automaton."""

    def locate(batches: Iterable[pa.RecordBatch]):
        shard, automaton, numbers, owners = None, None, {}, {}
        for batch in batches:
            ids, hashes, starts, counts = [], [], [], []
            for now, doc_id, row, own, start, words in rows_of([batch]):
                if now != shard:
                    shard, automaton, numbers, owners = now, None, {}, {}
                if own:
                    symbols = [numbers.setdefault(w, len(numbers)) for w in words.split(b" ")]
                    for i in range(len(symbols) - width + 1):
                        window = tuple(symbols[i : i + width])
                        owners[window] = min(owners.get(window, doc_id), doc_id)
                    continue
                if automaton is None:
                    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
                    for window, first in owners.items():
                        automaton.add_word(window, first)
                    automaton.make_automaton()
                    owners = {}
                last = None
                if not len(automaton):
                    continue
                for end, first in automaton.iter(tuple(numbers.get(w, -1) & 0xFFFFFFFF for w in words.split(b" "))):
                    if first < doc_id:
                        at = start + end - width + 1
                        if last is not None and at == last + 1:
                            counts[-1] += 1
                        else:
                            ids.append(doc_id)
                            hashes.append(row)
                            starts.append(at)
                            counts.append(1)
                        last = at
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(starts, pa.int32()), pa.array(counts, pa.int32())], ["doc_id", "row", "start", "count"]
            )

    return locate


def _remove(width: int):
    def remove(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            out: list[tuple] = []
            for doc_id, row, text, runs in rows_of([batch]):
                words = space_words(text)
                gone = np.zeros(len(words) + 1, np.int32)
                for r in runs:
                    gone[r["start"]] += 1
                    gone[min(len(words), r["start"] + r["count"] + width - 1)] -= 1
                stays = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                kept = b" ".join([words[i] for i in stays])
                out.append((doc_id, row, len(words) - len(stays), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[j] for x in out], k) for j, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))],
                ["doc_id", "row", "n_removed", "kept_sha256", "kept_text"],
            )

    return remove


def _with_text(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """Documents that have runs, with all of them; ``row`` is the hash of the text and tells equal doc_ids apart."""
    whole = stored(runs.groupBy("doc_id", "row").agg(F.collect_list(F.struct(*[c for c in runs.columns if c not in ("doc_id", "row")])).alias("runs")))
    ids = stored(whole.select("doc_id").distinct())
    return matching(texts, ids, ["doc_id"], "left_semi").dropDuplicates(["doc_id", "row"]).join(whole, ["doc_id", "row"]).select("doc_id", "row", "text", "runs")


def locate_passages(docs: DataFrame, width: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts with ``row``, profiles, removals): every place where a window of an earlier document recurs.

    1. Windows are dealt to hash buckets and confirmed as recurring; each has an owner, a document
       with a smaller doc_id that holds it.
    2. Runs of owned windows are the passages; they are cut out of their documents and dealt to shards
       by owner.  A shard compiles its passages into one automaton over word numbers.
    3. The parts of documents that hold a shard's windows are streamed through its automaton, which
       finds every occurrence word by word.  A document meets the shards of its owners only.
    """
    spark = docs.sparkSession
    text = plain_text()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))
    buckets = max(16, shuffle_partitions(spark))
    shards = min(MAX_SHARDS, 8 * buckets)
    packed = texts.where("doc_id is not null").mapInArrow(_pack(width, buckets, shards), _PACKED)
    answers = packed.groupBy("key").applyInArrow(_recurring(shards), _PACKED)
    gathered = stored(answers.groupBy("chunk").applyInArrow(_gather, _RUNS + ", n_words long, whole_sha256 string"))
    profiles = gathered.where("own is null").select("doc_id", "row", "n_words", "whole_sha256")
    runs = gathered.where("own is not null").select("doc_id", "row", "own", "shard", "start", "count").distinct()
    cuts = _with_text(texts, runs).mapInArrow(_cut(width), "shard int, doc_id long, row long, own boolean, start int, words binary")
    # a shard's passages come before the texts
    sharded = cuts.repartition(shards, "shard").sortWithinPartitions("shard", F.desc("own"))
    found = sharded.mapInArrow(_locate(width), "doc_id long, row long, start int, count int")
    return texts, profiles, stored(found)


def without_repeats(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept_text.

    A word goes when a window of ``width`` words covers it whose sequence also starts in a document with
    a smaller doc_id; windows are judged on the input.  Words are runs of anything but ASCII white space;
    NULL has none.  ``kept_text`` joins the kept words by one space and is NULL where nothing was
    removed.  Rows with the same doc_id never remove each other's words; a row with a NULL doc_id neither
    loses words nor makes others lose any.  An empty table gives an empty result; further columns are
    ignored.
    """
    texts, profiles, found = locate_passages(docs, width)
    removed = _with_text(texts, found).mapInArrow(_remove(width), "doc_id long, row long, n_removed long, kept_sha256 string, kept_text string")
    named = profiles.join(removed, ["doc_id", "row"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"), "kept_text",
    )
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    nameless = texts.where("doc_id is null").select(
        "doc_id", F.size(words).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"),
        F.sha2(F.array_join(words, " "), 256).alias("kept_sha256"), F.lit(None).cast("string").alias("kept_text"),
    )
    return named.unionByName(nameless)
