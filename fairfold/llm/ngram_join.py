"""Near duplicates: a Jaccard join of word n-gram sets over prefix trees."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairfold.llm.graph import components, links_in_families
from fairfold.llm.text import (
    matching, plain_text, rows_of, shuffle_partitions, space_words, starts_of_runs, stored, window_hashes, word_hashes,
)

WORDS = 5
PERCENT = 75
CHUNK = 1_000_000  # n-grams a task packs at a time
TREE_SETS = 2_000  # sets in one tree
PIVOTS = 64  # sets of a large family that meet all others of it

_PACKED = "key long, chunk long, at binary, a binary, b binary, c binary"
_ANSWER = "chunk long, packed boolean, a binary, b binary, c binary"


def ngram_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams; a shorter text is one n-gram, an empty one none."""
    h = word_hashes(space_words(text.lower()))
    return np.unique(window_hashes(h, min(words, len(h)))) if len(h) else np.empty(0, np.uint64)


def _digest(ngrams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(ngrams.tobytes())


def _pack(words: int, buckets: int):
    """Deal the n-grams of a run of documents out to hash buckets, one packed row for each bucket.

    An n-gram that several documents of the run share is counted for them here and sent once, for
    nobody (document 65535), so a frequent one reaches its bucket once a run, not once a document.
    """

    def pack(batches: Iterable[pa.RecordBatch]):
        ids: list = []
        sets: list[np.ndarray] = []
        size = 0

        def flush():
            n = np.array([len(s) for s in sets], np.int32)
            known = np.array([-1 if i is None else i for i in ids], np.int64)
            h = np.concatenate(sets)
            doc = np.repeat(np.arange(len(sets), dtype=np.uint16), n)
            chunk = xxhash.xxh64_intdigest(known.tobytes() + h.tobytes()) >> 1
            order = np.argsort(h, kind="stable")
            h, doc = h[order], doc[order]
            first = starts_of_runs(h)
            run = np.cumsum(first) - 1
            several = (np.bincount(run, minlength=1) > 1)[run] if len(h) else np.empty(0, bool)
            local = np.bincount(doc[several], minlength=len(sets)).astype(np.int32)
            doc = np.where(several, np.uint16(65535), doc)[first]
            h = h[first]
            nulls = np.array([i is None for i in ids], bool)
            rows = [(-1 - chunk % buckets, chunk, nulls.tobytes(), known.tobytes(), n.tobytes() + local.tobytes(), b"".join(_digest(s) for s in sets))]
            bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            low = h.astype(np.uint32)
            edge = np.searchsorted(bucket, np.arange(buckets + 1))
            for b in range(buckets):
                lo, hi = edge[b], edge[b + 1]
                if lo < hi:
                    rows.append((b, chunk, doc[lo:hi].tobytes(), low[lo:hi].tobytes(), b"", b""))
            ids.clear()
            sets.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())]
                + [pa.array([r[j] for r in rows], pa.binary()) for j in (2, 3, 4, 5)],
                ["key", "chunk", "at", "a", "b", "c"],
            )

        for doc_id, text in rows_of(batches):
            ids.append(doc_id)
            sets.append(ngram_set(text, words))
            size += len(sets[-1])
            if size >= CHUNK or len(ids) >= 60_000:
                yield flush()
                size = 0
        if ids:
            yield flush()

    return pack


def _match(table: pa.Table) -> pa.Table:
    """In one bucket: for each run, how many n-grams of which document another run holds as well."""
    keys = table["key"].to_pylist()
    chunk, at, a, b, c = (table[n].to_pylist() for n in ("chunk", "at", "a", "b", "c"))
    out: list[tuple] = []
    if keys[0] < 0:
        out = [(chunk[i], False, at[i] + a[i], b[i], c[i]) for i in range(len(keys))]
    else:
        h = np.concatenate([np.frombuffer(x, np.uint32) for x in a])
        doc = np.concatenate([np.frombuffer(x, np.uint16) for x in at])
        run = np.repeat(np.arange(len(a), dtype=np.uint32), [len(x) // 4 for x in a])
        order = np.argsort(h, kind="stable")
        first = starts_of_runs(h[order])
        several = np.empty(len(h), bool)
        same = np.cumsum(first) - 1
        several[order] = (np.bincount(same) > 1)[same]
        several &= doc != 65535
        kept = np.flatnonzero(several)
        edges = np.searchsorted(run[kept], np.arange(len(a) + 1))
        for r in range(len(a)):
            got = np.bincount(doc[kept[edges[r] : edges[r + 1]]])
            found = np.flatnonzero(got)
            out.append((chunk[r], True, found.astype(np.uint16).tobytes(), got[found].astype(np.uint32).tobytes(), b""))
    return pa.table(
        [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.bool_())] + [pa.array([x[j] for x in out], pa.binary()) for j in (2, 3, 4)],
        ["chunk", "packed", "a", "b", "c"],
    )


def _unpack(table: pa.Table) -> pa.Table:
    """One row per document of a run: its n-grams, its digest, and how many of them others hold."""
    out: dict[str, list] = {"doc_id": [], "n": [], "digest": [], "shared": []}
    rows = list(zip(*(table[n].to_pylist() for n in ("packed", "a", "b", "c")), strict=True))
    heads = [r for r in rows if not r[0]]
    for _, a, b, c in heads:
        docs = len(c) // 16
        nulls, ids = np.frombuffer(a[:docs], bool), np.frombuffer(a[docs:], np.int64)
        n, shared = np.frombuffer(b, np.int32).reshape(2, docs)
        shared = shared.astype(np.int64)
        for packed, at, counts, _ in rows:
            if packed:
                shared[np.frombuffer(at, np.uint16)] += np.frombuffer(counts, np.uint32)
        out["doc_id"] += [None if z else i for z, i in zip(nulls.tolist(), ids.tolist(), strict=True)]
        out["n"] += n.tolist()
        out["digest"] += [c[16 * i : 16 * i + 16] for i in range(docs)]
        out["shared"] += shared.tolist()
    return pa.table([pa.array(out["doc_id"], pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["digest"], pa.binary()), pa.array(out["shared"], pa.int64())], ["doc_id", "n", "digest", "shared"])


def set_profiles(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, n, digest, shared`` per document; ``shared`` counts its n-grams that other documents hold.

    The count is exact or, for a few n-grams in a million, one too high: buckets compare shortened
    hashes.  It only decides which sets go on, so too high is harmless.
    """
    buckets = max(16, 2 * shuffle_partitions(docs.sparkSession))
    packed = docs.mapInArrow(_pack(words, buckets), _PACKED)
    answers = packed.groupBy("key").applyInArrow(_match, _ANSWER)
    return answers.groupBy("chunk").applyInArrow(_unpack, "doc_id long, n long, digest binary, shared long")


def _needed(n, m, percent: int):
    """The least intersection of sets of n and m that reaches the threshold."""
    return -((-percent * (n + m)) // (100 + percent))


def tree_links(sets: list[tuple[np.ndarray, int, bool, bool]], percent: int) -> np.ndarray:
    """Groups of linked sets as labels, from a prefix tree of members that all probes walk together.

    A set is (its keys in global order, its size, member?, probe?); keys that no other set holds are
    left out of the keys and count in the size.  Members are walked in lexicographic order, so a path
    that consecutive members share is counted once for all of them: ``overlap`` holds, for every probe,
    how many keys of the current path it contains.  Where the keys that remain cannot lift any probe to
    the threshold for any size below, the subtree is left out.
    """
    label = np.arange(len(sets))
    probes = np.array([i for i, s in enumerate(sets) if s[3]], np.int64)
    members = sorted((s[0].tolist(), i) for i, s in enumerate(sets) if s[2] and len(s[0]))
    if not len(probes) or not members:
        return label
    keys = np.concatenate([sets[i][0] for i in probes])
    owner = np.repeat(np.arange(len(probes)), [len(sets[i][0]) for i in probes])
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    begin = dict(zip(*(x.tolist() for x in np.unique(keys, return_index=True)), strict=True))
    ends = dict(zip(begin, [*list(begin.values())[1:], len(keys)], strict=True))
    post = {k: owner[b : ends[k]] for k, b in begin.items()}
    probe_size = np.array([sets[i][1] for i in probes])
    probe_keys = np.array([len(sets[i][0]) for i in probes])
    common = [0] * (len(members) + 1)
    for j in range(1, len(members)):
        x, y = members[j - 1][0], members[j][0]
        k = 0
        while k < min(len(x), len(y)) and x[k] == y[k]:
            k += 1
        common[j] = k
    overlap = np.zeros(len(probes), np.int64)
    path: list[int] = []
    j = 0
    while j < len(members):
        own, i = members[j]
        while len(path) > common[j]:
            gone = post.get(path.pop())
            if gone is not None:
                overlap[gone] -= 1
        size = sets[i][1]
        # the branching point, or the end of the keys without which no partner can be reached
        stop = max(common[j], min(len(own), len(own) - _needed(size, size, percent) + 1), 1)
        last = j + 1
        for k in range(common[j], len(own)):
            path.append(own[k])
            held = post.get(own[k])
            if held is not None:
                overlap[held] += 1
            if k + 1 == stop:
                while last < len(members) and common[last] >= stop:
                    last += 1
                least = min(sets[m[1]][1] for m in members[j:last])
                most = max(len(m[0]) for m in members[j:last]) - stop
                reach = overlap + np.minimum(most, probe_keys - overlap)
                if not (reach >= _needed(least, probe_size, percent)).any():
                    break
                last = j + 1
        else:
            linked = probes[overlap >= _needed(size, probe_size, percent)]
            met = np.unique(label[np.append(linked, i)])
            if len(met) > 1:
                label[np.isin(label, met)] = met[0]
        j = last
    return label


def _trees(percent: int):
    """Links of one task's sets as a star per group: (smallest set, other set)."""

    def trees(table: pa.Table) -> pa.Table:
        family, ids = table["family"].to_numpy(), table["id"].to_numpy()
        sizes, member, probe = table["n"].to_numpy(), table["member"].to_pylist(), table["probe"].to_pylist()
        keys = table["keys"].combine_chunks()
        flat, offsets = keys.flatten(), keys.offsets.to_numpy() - keys.offsets[0].as_py()
        df, token = flat.field("df").to_numpy(), flat.field("token").to_numpy()
        a, b = [], []
        for f in np.unique(family):
            rows = np.flatnonzero(family == f)
            spans = [(offsets[r], offsets[r + 1]) for r in rows]
            tokens = np.concatenate([token[x:y] for x, y in spans])
            uniq, at, inverse = np.unique(tokens, return_index=True, return_inverse=True)
            rank = np.empty(len(uniq), np.int64)
            rank[np.lexsort((uniq, np.concatenate([df[x:y] for x, y in spans])[at]))] = np.arange(len(uniq))
            parts = np.split(rank[inverse], np.cumsum([y - x for x, y in spans])[:-1])
            label = tree_links([(np.sort(p), int(sizes[r]), member[r], probe[r]) for p, r in zip(parts, rows, strict=True)], percent)
            for g in np.unique(label):
                group = np.sort(ids[rows[label == g]])
                a += [group[0]] * (len(np.unique(group)) - 1)
                b += np.unique(group)[1:].tolist()
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return trees


def linked_sets(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``node, component`` of every set that links to another; sets are ``set_id, n, tokens`` without repeats.

    Keys are ordered from rare to frequent.  Two sets can only link if they share one of their first
    n - ceil(percent of n) + 1 keys, and a key that only one set holds is shared with nobody.  Sets that
    meet in such a first key form a family; families are joined in prefix trees.
    """
    one = sets.select("set_id", F.explode("tokens").alias("token")).repartition("token")
    df = one.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    keyed = one.join(df, "token").groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("keys"))
    keyed = keyed.join(sets.select("set_id", "n"), "set_id")
    firsts = F.size("keys") - F.floor((F.col("n") * percent + 99) / 100) + 1
    keyed = stored(keyed.withColumn("firsts", firsts.cast("int")).where("firsts >= 1"))
    posted = keyed.select("set_id", F.explode(F.slice("keys", 1, F.col("firsts"))["token"]).alias("token"))
    lead = posted.groupBy("token").agg(F.min("set_id").alias("a"), F.count("*").alias("sets")).where("sets > 1")
    met = posted.join(lead, "token").where("set_id > a").select("a", F.col("set_id").alias("b")).distinct()
    family = components(met).select(F.col("node").alias("set_id"), F.col("component").alias("family"))
    family = stored(keyed.drop("firsts").join(family, "set_id").withColumnRenamed("set_id", "id"))
    return links_in_families(family.select("family", "id", "n", "keys"), _trees(percent), TREE_SETS, PIVOTS)


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Documents link when the Jaccard similarity of their sets of distinct ``words``-word n-grams (words
    split at ASCII white space, A-Z lower-cased) is at least ``percent`` percent; the component is the
    smallest doc_id that links reach.  A text of fewer words is one n-gram.  NULL and blank texts have
    the empty set and link with nothing.  Rows with the same doc_id are separate documents with one
    name; a row with a NULL doc_id links like any other but names no component, unless all do.  An
    empty table gives an empty result; further columns are ignored.  N-grams are compared by 64-bit
    hashes.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_text().alias("text"))
    profiles = stored(set_profiles(texts, words))
    # a linked set shares at least ``percent`` of its n-grams
    going = profiles.where(f"n > 0 and 100 * shared >= {percent} * n")
    named = stored(going.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")))

    def sets(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                got = [ngram_set(t, words) for _, t in rows_of([batch.slice(begin, 512)])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([_digest(g) for g in got], pa.binary()), pa.array([len(g) for g in got], pa.int64()),
                        pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(g) for g in got]))).astype(np.int32), pa.array(np.concatenate(got).view(np.int64))),
                    ],
                    ["digest", "n", "tokens"],
                )

    ids = stored(named.select("doc_id").distinct())
    wanted = matching(texts.where("doc_id is not null"), ids.where("doc_id is not null"), ["doc_id"], "left_semi")
    if named.where("doc_id is null").limit(1).count():
        wanted = wanted.unionByName(texts.where("doc_id is null"))
    read = wanted.mapInArrow(sets, "digest binary, n long, tokens array<long>").dropDuplicates(["digest"])
    read = stored(read.join(named.select("digest"), "digest", "left_semi").withColumn("set_id", F.monotonically_increasing_id()))
    groups = linked_sets(read.select("set_id", "n", "tokens"), percent)
    named = named.join(read.select("digest", "set_id"), "digest").join(groups.withColumnRenamed("node", "set_id"), "set_id", "left")
    named = named.withColumn("component", F.coalesce("component", "set_id"))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(smallest, "component").select("digest", "component_id")
    return profiles.join(named, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id")
    )
