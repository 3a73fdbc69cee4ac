import collections
import math
import re
import tracemalloc
import zlib

import numpy as np
import pytest

from fairfold.llm import chat_format, decontaminate, exact_dedup, graph, license_scan, line_dedup, lm_score, ngram_join, phrase_dedup, pieces, sentencepiece_codec, toxicity

from . import brute


@pytest.fixture(scope="module")
def docs(spark):
    return brute.odd_documents(spark).cache()


def rows(df, *columns):
    return brute.in_order(df.select(*columns).collect() if columns else df.collect())


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_exact_groups(docs):
    assert rows(exact_dedup.exact_groups(docs)) == brute.in_order(brute.exact(brute.pairs(docs)))


@pytest.mark.parametrize("limit", [2000, 3])
def test_near_duplicates(docs, monkeypatch, limit):
    monkeypatch.setattr(ngram_join, "TREE_SETS", limit)
    monkeypatch.setattr(ngram_join, "PIVOTS", min(64, limit - 1))
    assert rows(ngram_join.near_duplicates(docs)) == brute.in_order(brute.jaccard(brute.pairs(docs)))


def test_prefix_tree_equals_all_pairs():
    rng = np.random.default_rng(5)
    base = [np.sort(rng.choice(80, 30, replace=False)) for _ in range(6)]
    sets = []
    for _ in range(60):
        own = np.unique(np.concatenate((rng.permutation(base[rng.integers(6)])[: rng.integers(22, 31)], rng.choice(80, rng.integers(0, 4)))))
        sets.append((own, len(own), True, True))
    label = ngram_join.tree_links(sets, 75)
    want = list(range(60))
    for a in range(60):
        for b in range(a):
            both = len(np.intersect1d(sets[a][0], sets[b][0]))
            if 100 * both >= 75 * (len(sets[a][0]) + len(sets[b][0]) - both):
                want = [want[b] if g == want[a] else g for g in want]
    same = {(x, y) for x, y in zip(label.tolist(), want, strict=True)}
    assert len(same) == len(set(want)) == len(set(label.tolist()))


def test_phrase_dedup(docs, monkeypatch):
    expected = brute.in_order(brute.phrases(brute.pairs(docs)))
    assert rows(phrase_dedup.without_repeats(docs).drop("kept_text")) == expected
    monkeypatch.setattr(phrase_dedup, "SPAN", 50)
    monkeypatch.setattr(phrase_dedup, "CHUNK", 100)
    assert rows(phrase_dedup.without_repeats(docs).drop("kept_text")) == expected


def test_decontamination(spark, docs):
    items = spark.createDataFrame(
        [(1, brute.long(3, 6)), (2, "One two"), (3, None), (4, ""), (None, brute.long(0, 3)), (5, brute.long(3, 6)), (6, "ONE"), (7, "nowhere at all")], "item_id long, text string"
    )
    got = decontaminate.contamination(docs, items)
    assert rows(got.drop("item_ids")) == brute.in_order(brute.benchmark(brute.pairs(docs), brute.pairs(items.withColumnRenamed("item_id", "doc_id"))))


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta gamma"), (2, "beta alpha delta"), (3, "alpha q q q q q beta gamma")], "doc_id long, text string")
    items = spark.createDataFrame([("a", "alpha beta gamma")], "item_id string, text string")
    assert {r["doc_id"] for r in decontaminate.contamination(docs, items).where("contaminated").collect()} == set()
    near = decontaminate.contamination(docs, items, slop=2)
    assert {r["doc_id"] for r in near.where("contaminated").collect()} == {1}


@pytest.mark.parametrize("limit", [8, 1])
def test_line_dedup(spark, docs, monkeypatch, limit):
    monkeypatch.setattr(line_dedup, "NEIGHBOURS", limit)
    text = "the quick brown fox jumps over the lazy dog again and again until number {} is reached by all of them in the evening"
    more = spark.createDataFrame([(100 + i, text.format(i) + "\nshort\nthe end x" + ("" if i % 2 else ".")) for i in range(40)], "doc_id long, text string")
    table = docs.select("doc_id", "text").unionByName(more)
    rows_ = brute.pairs(table)
    place, normal = collections.defaultdict(list), {}
    for i, t in set(rows_):
        for n, line in enumerate((t or "").encode().split(b"\n")):
            w = line_dedup.normal_words(line) or line.split()
            if len(w) >= line_dedup.MIN_WORDS:
                normal[b" ".join(w)] = w
                place[b" ".join(w)].append((i is not None, i, t, n))
    keys = list(normal)
    group = list(range(len(keys)))
    for a in range(len(keys)):
        for b in range(a):
            if line_dedup.similar(keys[a], keys[b]):
                group = [group[b] if g == group[a] else g for g in group]
    kept = {}
    for k, g in zip(keys, group, strict=True):
        kept[g] = min([p for p in [kept.get(g), *place[k]] if p], key=lambda p: (p[0], p[1] or 0))
    lost = {r["doc_id"]: 0 for r in line_dedup.dedup_lines(table).collect()}
    for r in line_dedup.dedup_lines(table).collect():
        lost[r["doc_id"]] += r["n_removed"]
    want = collections.Counter()
    for k, g in zip(keys, group, strict=True):
        for p in place[k]:
            want[p[1]] += rows_.count((p[1], p[2])) * (p[:2] + p[3:] != kept[g][:2] + kept[g][3:])
    assert {k: v for k, v in lost.items() if v and k != 10} == {k: v for k, v in want.items() if v and k != 10}
    assert line_dedup.replace_text(docs).columns == docs.columns and line_dedup.replace_text(docs).count() == docs.count()


def test_edit_distance():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (bytes(rng.integers(97, 100, rng.integers(0, 14)).tolist()) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        assert line_dedup.edit_distance(a, b, 99) == row[-1]
        assert (line_dedup.edit_distance(a, b, 3) <= 3) == (row[-1] <= 3)


def test_base_scores(docs):
    table = brute.pairs(docs)
    tokens = [(i, brute.words(brute.lower(t or "")) + [0]) for i, t in table]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in table]
    count = collections.Counter(w for (_, ws), h in zip(tokens, held, strict=True) if not h for w in ws)
    n, v = sum(count.values()), len(count)
    got = rows(lm_score.text_scores(docs, class_column="lang"), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")
    want = brute.in_order(
        (i, h, len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)) for (i, ws), h in zip(tokens, held, strict=True)
    )
    assert [g[:5] for g in got] == [w[:5] for w in want] and np.allclose([g[5] for g in got], [w[5] for w in want])
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in lm_score.text_scores(docs).collect())


def test_lattice_sums_over_all_segmentations():
    vocabulary = pieces.load()
    logp = pieces.prior(vocabulary)
    word = "▁thes日"
    held = {vocabulary.text[i]: i for n in vocabulary.hashes for i in vocabulary.hashes[n][1].tolist()}

    def total(at):
        if at == len(word):
            return 1.0
        out = 0.0
        for n in range(1, len(word) - at + 1):
            part = word[at : at + n]
            if part in held:
                out += math.exp(logp[held[part]]) * total(at + n)
            elif n == 1:
                out += math.exp(sum(logp[vocabulary.byte[b]] for b in part.encode())) * total(at + n)
        return out

    _, lattice = next(pieces.lattices(vocabulary, [word[1:]]))
    assert math.isclose(lattice.forward(lattice.weights(logp))[-1][0], math.log(total(0)), rel_tol=1e-9)
    # every character is covered once on average
    used = lattice.expected(lattice.weights(logp), len(logp))
    size = sum(used[i] * len(t) for t, i in held.items())
    assert math.isclose(size, len(word), rel_tol=1e-6)


def test_codec(spark, docs):
    got = sentencepiece_codec.encode_texts(docs)
    table = collections.Counter((i, t or "") for i, t in brute.pairs(docs))
    assert collections.Counter((r["doc_id"], r["text"]) for r in sentencepiece_codec.decode_ids(got).collect() if "▁" not in (r["text"] or "") and r["doc_id"] != 14) == collections.Counter(
        {k: n for k, n in table.items() if k[0] != 14}
    )
    assert {r["doc_id"] for r in got.where("not round_trip").collect()} == {14}
    vocabulary = pieces.load()
    logp = sentencepiece_codec.piece_weights(vocabulary)
    split = re.compile(sentencepiece_codec.word_pattern(vocabulary)).findall
    ids = {(r["doc_id"], r["n_pieces"]): list(r["ids"]) for r in got.collect()}
    for i, t in brute.pairs(docs):
        whole = "▁" + t.replace(" ", "▁") if t else ""
        if len(whole) < 3000:
            best = [x for w in split(whole) for x in sentencepiece_codec.best_path(vocabulary, logp, w)]
            assert ids[i, len(best)] == best


def test_toxicity(spark, docs):
    bad = "you are a zorgle and a frumptious blatherskite"
    told = spark.createDataFrame(
        [(1000 + i, f"{PLAIN[i % 5]} {bad if i % 3 == 0 else ''} text number {i}") for i in range(300)], "doc_id long, text string"
    )
    labels = told.selectExpr("doc_id", "cast(text like '%zorgle%' as int) toxic", "1 quality").unionByName(spark.createDataFrame([(None, 1, 0), (1001, None, 1), (99, 5, 0)], "doc_id long, toxic int, quality int"))
    table = told.unionByName(docs.select("doc_id", "text"))
    got = toxicity.scores(table, labels).collect()
    assert len(got) == table.count() and all(0 <= r["score"] <= 1 for r in got)
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] >= 1000:
            assert r["predicted"] == int((r["doc_id"] - 1000) % 3 == 0)
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
            assert not any(zlib.crc32(str(n).encode()) % 3 == 1 for n in r["neighbours"])
    assert all(r["predicted"] == 0 for r in toxicity.scores(docs, labels.limit(0)).collect())


PLAIN = ["the river runs to the sea", "a house on the hill", "they walked in the rain", "bread and butter for tea", "the train left at noon"]


@pytest.mark.parametrize("long_share", [toxicity.LONG_SHARE, 2.0])
def test_block_max_search_is_exact(monkeypatch, long_share):
    monkeypatch.setattr(toxicity, "LONG_SHARE", long_share)
    rng = np.random.default_rng(3)
    terms = np.sort(rng.integers(1, 2**63, 90).astype(np.uint64))
    vectors = []
    for i in range(700):
        own = np.sort(rng.choice(terms, rng.integers(0, 9), replace=False, p=np.arange(90, 0, -1) / 4095))
        vectors.append((i, i % 2, own, rng.integers(1, 4, len(own))))
    index = toxicity.build_index(vectors, terms, rng.integers(5, 90, 90), 500)
    assert (len(index.long_weight) > 0) == (long_share < 1)
    vectors = [vectors[i] for i in index.ids]
    dense = np.zeros((700, 90))
    for e, v in enumerate(vectors):
        at, w = index.vector(*v[2:])
        dense[e, at] = w
    for e in range(60):
        found, got = index.nearest(*index.vector(*vectors[e][2:]), 15)
        want = np.sort(dense @ dense[e])[::-1][:15]
        assert np.allclose(got, want[want > 0][: len(got)], atol=2e-6) and len(got) == np.count_nonzero(want > 1e-6)
        assert np.allclose((dense @ dense[e])[found], got, atol=2e-6)


@pytest.mark.parametrize("opened", [toxicity.OPENED, 1])
def test_texts_that_are_searched_together_get_what_each_gets_alone(monkeypatch, opened):
    monkeypatch.setattr(toxicity, "OPENED", opened)
    rng = np.random.default_rng(8)
    terms = np.sort(rng.integers(1, 2**63, 300).astype(np.uint64))
    share = np.arange(300, 0, -1) / (300 * 301 / 2)
    vectors = []
    for i in range(3000):
        own = np.sort(rng.choice(terms, rng.integers(0, 25), replace=False, p=share))
        vectors.append((i, int(i % 3 == 0), own, np.ones(len(own), np.int64)))
    index = toxicity.build_index(vectors, terms, rng.integers(5, 900, 300), 3500)
    assert len(index.long_weight)
    dense = np.zeros((3000, 300))
    for e, i in enumerate(index.ids.tolist()):
        at, w = index.vector(*vectors[i][2:])
        dense[e, at] = w
    unknown = (np.array([5], np.uint64), np.array([1]))
    texts = [v[2:] for v in vectors[:150]] + [unknown, (np.empty(0, np.uint64), np.empty(0, np.int64))]
    lot = index.votes(texts, 15)
    assert len(lot) == len(texts) and lot[150:] == [([], [])] * 2
    own = {int(i): e for e, i in enumerate(index.ids)}
    without = index.votes(texts[:150], 15, [own[i] for i in range(150)])
    for i in range(150):
        assert index.votes(texts[i : i + 1], 15)[0][1] == lot[i][1]
        if not len(texts[i][0]):
            continue
        cosines = dense @ dense[own[i]]
        best = np.sort(cosines)[::-1][:15]
        assert abs(lot[i][0][3] - best[best > 0].mean()) < 2e-6
        cosines[own[i]] = 0
        best = np.sort(cosines)[::-1][:15]
        assert i not in without[i][1] and abs(without[i][0][3] - best[best > 0].mean()) < 2e-6


def test_index_is_made_in_little_memory():
    rng = np.random.default_rng(5)
    terms = np.sort(rng.choice(2**62, 2000, replace=False)).astype(np.uint64)
    size = rng.integers(0, 400, 3000)
    at = np.concatenate([np.sort(rng.choice(2000, n, replace=False)) for n in size]).astype(np.int32)
    counts = rng.integers(1, 9, len(at)).astype(np.uint8)
    ids, label = rng.permutation(3000), np.arange(3000) % 3 // 2
    tracemalloc.start()
    fields = toxicity.index_fields(ids, label, size, at, counts, terms, rng.integers(5, 90, 2000), 500)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 * len(at) + 1_000_000  # a list's entry has 3 bytes
    index = toxicity.Index(*fields)
    cuts = np.concatenate(([0], np.cumsum(size)))
    want = {(int(ids[e]), int(t)): int(c) for e in range(3000) for t, c in zip(at[cuts[e] : cuts[e + 1]], counts[cuts[e] : cuts[e + 1]], strict=True)}
    term = np.repeat(np.arange(2000), index.size)
    assert {(int(i), int(t)): int(c) for i, t, c in zip(index.ids[index.held], term, index.counts, strict=True)} == want
    assert all((np.diff(index.held[index.start[t] : index.start[t + 1]]) > 0).all() for t in range(2000))
    assert {int(i): int(y) for i, y in zip(index.ids, index.labels, strict=True)} == dict(zip(ids.tolist(), label.tolist(), strict=True))


def toxicity_by_force(told, marks, k=toxicity.NEIGHBOURS):
    """Scores of (doc_id, text) rows by all cosines, from the definition; ``marks`` are the examples' labels."""
    def terms(text):
        words = re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
        return collections.Counter(words + [w[:n] + "*" for n in toxicity.BEGINNINGS for w in words if len(w) > n])

    held = {i: terms(text) for i, text in told}
    df = collections.Counter(t for c in held.values() for t in c)
    n = [sum(y == label for y in marks.values()) for label in (0, 1)]
    of = [collections.Counter(t for i, y in marks.items() if y == label for t in held[i]) for label in (0, 1)]

    def factor(t):
        both = (of[0][t] + of[1][t]) / sum(n)
        gain = sum(2 * x * math.log(x / e) for y in (0, 1) for x, e in ((of[y][t], n[y] * both), (n[y] - of[y][t], n[y] * (1 - both))) if x)
        gain = max(0.0, gain)
        return (math.log((1 + len(told)) / (1 + df[t])) + 1) * (toxicity.EVEN + (1 - toxicity.EVEN) * gain / (gain + toxicity.HALF_GAIN))

    def vector(c):
        out = {t: (1 + math.log(x)) * factor(t) for t, x in c.items() if of[0][t] + of[1][t]}
        norm = math.sqrt(sum(w * w for w in out.values()))
        return {t: w / norm for t, w in out.items()}

    vectors = {i: vector(c) for i, c in held.items()}
    bare = [y for i, y in marks.items() if not vectors[i]]
    prior = (sum(bare) + n[1] / sum(n)) / (len(bare) + 1)

    def said(i, but=None):
        near = sorted(((sum(w * vectors[e].get(t, 0.0) for t, w in vectors[i].items()), y) for e, y in marks.items() if e != but), reverse=True)[:k]
        near = [x for x in near if x[0] > 1e-6]
        total = sum(c for c, _ in near)
        return [1.0, (sum(c * y for c, y in near) + 0.5 * prior) / (total + 0.5), *(max([c for c, y in near if y == label], default=0.0) for label in (1, 0)), total / len(near)] if near else None

    fit = [(x, y) for i, y in marks.items() if (x := said(i, i))]
    x, y, curve = np.array([f[0] for f in fit]), np.array([f[1] for f in fit]), np.zeros(5)
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ curve))
        curve -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 0.1 * np.eye(5), x.T @ (p - y) + 0.1 * curve)
    return {i: float(1 / (1 + np.exp(-np.array(s) @ curve))) if (s := said(i)) else prior for i in held}


def test_toxicity_equals_all_cosines(spark):
    rng = np.random.default_rng(11)
    words = [f"word{i}" * (1 + i % 3) for i in range(400)] + ["Ärger", "ça"]
    told = []
    for i in range(260):
        own = rng.choice(words, rng.integers(5, 60)).tolist()
        own += rng.choice(["zorgle", "blathering", "frump", "word1"], 2).tolist() * (i % 4 == 0)
        told.append((i, " ".join(own)))
    told += [(300, None), (301, ""), (302, "unheard words only"), (303, "Zorgle! " * 100_000)]
    labels = [(i, int(i % 4 == 0 or i % 37 == 0), 1) for i, _ in told[:260]] + [(301, 0, 1)]
    marks = {i: y for i, y, _ in labels if zlib.crc32(str(i).encode()) % 3 != 1}
    docs = spark.createDataFrame([(i, text, 1, 2) for i, text in told], "doc_id long, text string, score int, row int")
    got = {r["doc_id"]: r["score"] for r in toxicity.scores(docs.unionByName(docs).repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")).collect()}
    want = toxicity_by_force(told + [(-1 - i, text) for i, text in told], marks)
    assert set(got) == {i for i, _ in told}
    for i in got:
        assert abs(got[i] - want[i]) < 1e-3, (i, got[i], want[i])
    assert len({round(v, 9) for v in got.values()}) > 250


def test_proximity_counts_words_once(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "x a b q c"), (3, "c x x x a"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([("i", "a a a"), ("j", "a b c")], "item_id string, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in decontaminate.contamination(docs, items, slop=2).collect()}
    assert got[1] == (1, 1, ["i"]) and got[2] == (5, 3, ["i", "j"]) and got[4] == (0, 0, [])
    assert got[3] == (5, 1, ["i"])


def test_chat(spark):
    turns = spark.createDataFrame(
        [(1, 0, "system", "be nice"), (1, 1, "ann", "hi <|x"), (1, 2, "bob", None), (1, 70, "ann", "é"), (2, 0, None, "me"), (None, None, "ann", "x"), (3, 0, "system", "alone"), (1, 1, "ann", "hi <|x")],
        "conv_id long, turn long, role string, text string",
    )
    got = {(r["conv_id"], r["speaker"], r["segment"]): r for r in chat_format.perspectives(turns).collect()}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (1, "ann", 1), (1, "bob", 1), (2, "unknown", 0), (None, "ann", None)}
    r = got[1, "ann", 0]
    assert r["text"] == "<|system|>\nbe nice<|end|>\n" + "<|assistant|>\nhi < |x<|end|>\n" * 2 + "<|user:bob|>\n<|end|>\n"
    assert [r["text"][m["start"] : m["end"]] for m in r["masks"]] == ["hi < |x"] * 2
    assert got[1, "bob", 1]["text"] == "<|user:ann|>\né<|end|>\n" and got[1, "bob", 1]["masks"] == []
    assert chat_format.perspectives(turns.limit(0)).count() == 0


def test_licences(spark):
    files = spark.createDataFrame(
        [("/a/LICENSE", "Released under the MIT License."), ("/a/b/x.py", "def f\nreturn 1"), ("/a/b/LICENSE", "Licensed under the Apache License, Version 2.0."), ("/a/y.py", "code"), ("/c/z", None),
         ("/a/b/c/w.py", "code here\n# This work is licensed under the GNU General Public License, version 3.\n" + "more code\n" * 50), (None, "x"), ("/a/b/c/v", "")],
        "path string, text string",
    )
    got = {r["path"]: (r["license"], r["origin"], r["from_path"]) for r in license_scan.scan(files).collect()}
    assert got == {
        "/a/LICENSE": ("MIT", "own", None), "/a/b/x.py": ("Apache-2.0", "inherited", "/a/b/LICENSE"), "/a/b/LICENSE": ("Apache-2.0", "own", None), "/a/y.py": ("MIT", "inherited", "/a/LICENSE"),
        "/c/z": (None, None, None), "/a/b/c/w.py": ("GPL-3.0", "own", None), None: (None, None, None), "/a/b/c/v": ("Apache-2.0", "inherited", "/a/b/LICENSE"),
    }
    assert license_scan.scan(files.limit(0)).count() == 0


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    for out in (
        exact_dedup.exact_groups(none), ngram_join.near_duplicates(none), phrase_dedup.without_repeats(none), line_dedup.dedup_lines(none), lm_score.text_scores(none),
        sentencepiece_codec.encode_texts(none), toxicity.scores(none, labels), decontaminate.contamination(none, items),
    ):
        assert out.count() == 0
    assert decontaminate.contamination(docs, items).where("contaminated").count() == 0
