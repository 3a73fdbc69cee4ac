"""The operators on what they once left out: repeated runs, far edits, short lines, whole licences, common words."""

import collections
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline

from fairfold.llm import decontaminate, line_dedup, lm_score, phrase_dedup, sentencepiece_codec, text

from . import brute


@pytest.fixture(scope="module")
def docs(spark):
    return brute.odd_documents(spark).cache()


def test_equal_runs_of_two_tasks(spark, docs):
    once = docs.coalesce(1)
    twice = once.union(once)
    alone = spark.createDataFrame([(None, None)] * 4 + [(5, "same words in each row")] * 4, "doc_id long, text string").repartition(8)
    assert alone.rdd.getNumPartitions() == 8
    for table in (twice, alone):
        pairs = brute.pairs(table)
        got = phrase_dedup.without_repeats(table).drop("kept_text").collect()
        assert brute.in_order(got) == brute.in_order(brute.phrases(pairs))
        ids = sentencepiece_codec.encode_texts(table).collect()
        assert collections.Counter(r["doc_id"] for r in ids) == collections.Counter(i for i, _ in pairs)
        assert all(r["round_trip"] or r["doc_id"] == 14 for r in ids)
        scored = lm_score.text_scores(table).collect()
        sizes = collections.Counter((r["doc_id"], r["n_tokens"]) for r in scored)
        assert sizes == collections.Counter((i, len(brute.words(t)) + 1) for i, t in pairs)
        assert all(r["n_known"] <= r["n_tokens"] for r in scored)


def edited(rng, line, edits):
    out = bytearray(line)
    for _ in range(edits):
        at, kind = int(rng.integers(len(out))), rng.integers(3)
        if kind == 0:
            out.insert(at, int(rng.integers(97, 123)))
        elif kind == 1:
            del out[at]
        else:
            out[at] = int(rng.integers(97, 123))
    return bytes(out)


def test_near_lines_by_edit_similarity_alone(spark):
    rng = np.random.default_rng(8)
    lines = []
    for n in range(120):
        words = [bytes(rng.integers(97, 123, rng.integers(2, 9)).tolist()) for _ in range(rng.integers(4, 40))]
        line = b" ".join(words)
        lines += [line, edited(rng, line, rng.integers(0, len(line) // 10 + 1)), b" ".join([b"q" * len(words[0]), *words[1:]])]
    table = spark.createDataFrame([(i, x.decode()) for i, x in enumerate(lines)], "doc_id long, text string")
    keys = [b" ".join(line_dedup.normal_words(x)) for x in lines]
    group = list(range(len(keys)))
    for a in range(len(keys)):
        for b in range(a):
            if line_dedup.similar(keys[a], keys[b]):
                group = [group[b] if g == group[a] else g for g in group]
    first = {}
    want = {i for i, g in enumerate(group) if first.setdefault(g, i) != i}
    assert len(want) > 150
    got = {r["doc_id"] for r in line_dedup.dedup_lines(table).collect() if r["n_removed"]}
    # short lines are found with certainty; long ones with one word changed nearly all, with edits at random places (up to 10 % of the bytes) about half
    assert got <= want
    assert {i for i in want if len(keys[i]) < 60} <= got
    word, anywhere = ([i for i in want if i % 3 == k and len(keys[i]) >= 64] for k in (2, 1))
    assert len(got.intersection(word)) >= 0.95 * len(word) and len(got.intersection(anywhere)) >= 0.4 * len(anywhere)


def test_no_long_pair_is_left_out(spark):
    """Edits spread over whole lines, as many as are allowed, and chains of lines that meet under few keys."""
    rng = np.random.default_rng(12)
    lines = []
    for n in range(150):
        line = bytes(rng.integers(97, 101, rng.integers(64, 400)).tolist())
        place = np.linspace(0, len(line) - 1, int(len(line) * 0.1)).astype(int)
        other = bytearray(line)
        for at in place:
            other[at] = 122
        lines += [line, bytes(other), edited(rng, line, len(line) // 12)]
    chain = bytearray(rng.integers(97, 123, 200).tolist())
    for at in range(0, 200, 5):  # each within reach of the next ones only
        chain[at : at + 5] = b"xyxyx"
        lines.append(bytes(chain))
    table = spark.createDataFrame([(i, x.decode()) for i, x in enumerate(lines)], "doc_id long, text string")
    group = list(range(len(lines)))
    for a in range(len(lines)):
        for b in range(a):
            if line_dedup.similar(lines[a], lines[b]):
                group = [group[b] if g == group[a] else g for g in group]
    first = {}
    want = {i for i, g in enumerate(group) if first.setdefault(g, i) != i}
    assert len(want) > 300
    assert {r["doc_id"] for r in line_dedup.dedup_lines(table).collect() if r["n_removed"]} == want


def test_digits_count(spark):
    table = spark.createDataFrame([(1, "Revenue 2019: 120\n12 34"), (2, "Revenue 2021: 987\n98 76"), (3, "REVENUE 2019 - 120")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(table).collect()} == {1: 0, 2: 0, 3: 1}


def test_many_like_lines_give_few_links(spark):
    """A key that a third of all lines share: links grow with the lines, not with their pairs."""
    rng = np.random.default_rng(2)
    words = [bytes(rng.integers(97, 123, 6).tolist()).decode() for _ in range(60)]
    like = [(i, " ".join([*words[:40], f"x{i}", *words[41:]])) for i in range(700)]
    other = [(1000 + i, " ".join(bytes(rng.integers(97, 123, 6).tolist()).decode() for _ in range(30))) for i in range(300)]
    table = spark.createDataFrame(like + other, "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(table).collect()}
    assert got == {i: int(0 < i < 700) for i, _ in like + other}


def test_clashing_names_of_columns(spark):
    names = ["_row", "_id", "_gone", "_kept", "row", "found_lines", "Found_Lines_", "digest"]
    table = spark.createDataFrame([(1, "the same line here"), (2, "the same line here\nown"), (None, None)], "doc_id long, text string")
    table = table.selectExpr("doc_id", "text", *[f"'{i}' as `{n}`" for i, n in enumerate(names)])
    out = line_dedup.replace_text(table)
    assert out.columns == table.columns and {(r["doc_id"], r["text"]) for r in out.collect()} == {(1, "the same line here"), (2, "own"), (None, None)}


def test_short_lines_share_a_segment():
    rng = np.random.default_rng(9)
    edits = line_dedup.most_edits(np.arange(72), 0.9).tolist()
    for _ in range(2000):
        a = bytes(rng.integers(97, 101, rng.integers(9, 64)).tolist())
        b = edited(rng, a, rng.integers(1, 7))
        if a != b and len(b) < 72 and line_dedup.similar(a, b):
            assert line_dedup.segment_keys(a, edits) & line_dedup.segment_keys(b, edits)


def test_lines_of_few_words(spark):
    han = "這是一個沒有空格的很長的句子它在兩個文件裡都出現而且完全一樣"
    texts = ["Ietzte.\n\n***\n" + han, "ietzte\n\n***\n" + han, "a b\n \n***", "A b!\n\t\n---\n" + han + "嗎"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["kept_text"]) for r in line_dedup.dedup_lines(table).collect()}
    assert got == {0: (0, texts[0]), 1: (3, ""), 2: (1, "a b\n "), 3: (2, "\t\n---")}


def test_items_without_id_contaminate(spark):
    docs = spark.createDataFrame([(1, "so " + brute.long(0, 3)), (2, brute.long(20, 23)), (3, "clean")], "doc_id long, text string")
    items = spark.createDataFrame([(None, brute.long(0, 3)), (None, brute.long(20, 23)), (7, brute.long(20, 23))], "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["contaminated"], r["item_ids"]) for r in decontaminate.contamination(docs, items).collect()}
    n = [len(brute.words(brute.long(a, a + 3))) for a in (0, 20)]
    assert got == {1: (n[0], True, []), 2: (n[1], True, ["7"]), 3: (0, False, [])}


def test_rows_of_one_doc_id_are_decided_each(spark, tmp_path):
    bad = "you are a zorgle and a frumptious blatherskite"
    told = [(1000 + i, f"the house number {i} on the hill {bad if i % 3 == 0 else ''}") for i in range(300)]
    extra = [(5000, f"so {bad}"), (5000, "the house on the hill"), (6000, brute.long(0, 3)), (6000, "bread and butter for tea"), (None, "bread"), (None, brute.long(0, 3))]
    docs = spark.createDataFrame(told + extra, "doc_id long, text string")
    docs.where("doc_id < 5000").selectExpr("doc_id", "cast(text like '%zorgle%' as int) toxic").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, brute.long(0, 3))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {tuple(r) for r in corpus_pipeline.not_toxic(spark, docs, str(tmp_path)).collect()}
    assert extra[0] not in left and extra[1] in left and extra[4] in left
    clean = {tuple(r) for r in corpus_pipeline.not_contaminated(spark, docs, str(tmp_path)).collect()}
    assert clean == set(told + extra) - {extra[2], extra[5]}


def test_control_characters_come_back(spark):
    texts = ["a\x00b", "a\x01\x02b", "\x00\x00 \x00", "a\x01b \x02", "plain"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sentencepiece_codec.encode_texts(table)
    assert all(r["round_trip"] for r in got.collect()) and len({tuple(r["ids"]) for r in got.collect()}) == 5
    assert {r["doc_id"]: r["text"] for r in sentencepiece_codec.decode_ids(got).collect()} == dict(enumerate(texts))


def _shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(1 for d in dirs for _ in Path(d.getPath()).rglob("shuffle_*"))


def test_shuffles_go_when_a_table_is_stored(spark):
    before = _shuffle_files(spark)
    table = text.stored(spark.range(1000).selectExpr("id % 7 k").groupBy("k").count())
    until = time.time() + 20
    while _shuffle_files(spark) > before and time.time() < until:
        time.sleep(0.2)
    assert _shuffle_files(spark) <= before and table.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_lines_are_the_same_in_many_parts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = [f"w{i}x{i * 7 % 31}" for i in range(60)]
    long = [" ".join(rng.choice(words, 25)) for _ in range(30)]
    lines = long + [x[:20] + "q" + x[24:] for x in long[::2]] + [x[:30] for x in long[::3]] + [x[:29] + "z" for x in long[::6]]
    table = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    keys = [b" ".join(line_dedup.normal_words(x.encode())) for x in lines]
    want = {b for b in range(len(keys)) for a in range(b) if line_dedup.similar(keys[a], keys[b])}
    monkeypatch.setattr(line_dedup, "PART_BYTES", 1)
    monkeypatch.setattr(line_dedup, "PARTS", 2)
    assert want and {r["doc_id"] for r in line_dedup.dedup_lines(table).where("n_removed > 0").collect()} == want


class _Even:
    value = np.zeros(line_dedup.COUNTERS, np.uint8)


def _keys_of(lines, **part):
    ids, size = np.arange(len(lines)), np.array([len(x) for x in lines], np.int32)
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids), pa.array(size), pa.array(lines, pa.binary())], ["id", "label", "size", "normal"])
    part = {"lower": 0, "upper": 1 << 40, "slices": 1, "rest": 0, "buckets": 1} | part
    return [x for found in line_dedup._keys(0.9, _Even, *part.values())([batch]) for x in found["rows"].to_pylist()]


def test_keys_of_lines_are_packed():
    rng = np.random.default_rng(5)
    lines = [bytes(rng.integers(97, 123, 400).tolist()) for _ in range(200)]
    assert sum(map(len, _keys_of(lines))) < 16 * sum(map(len, lines))  # rows of a key each took more than 40 bytes a byte


def test_a_passage_that_returns_in_a_line_is_compared_once(monkeypatch):
    rng = np.random.default_rng(6)
    passage = bytes(rng.integers(97, 123, 40).tolist())
    lines = [bytes(rng.integers(97, 123, 60).tolist()) + passage * 200, passage * 200 + bytes(rng.integers(97, 123, 70).tolist())]
    compared, test = [], line_dedup._test

    def counted(*of):
        found = test(*of)
        return lambda near, far, line, i, j: compared.append(len(i)) or found(near, far, line, i, j)

    monkeypatch.setattr(line_dedup, "_test", counted)
    out = line_dedup._close(0.9, None, 0, 1 << 40)(pa.table({"rows": pa.array(_keys_of(lines), pa.binary())}))
    assert out.to_pylist() == [{"a": 0, "b": 1}] and sum(compared) < 5000  # 200 * 200 of each of some twenty keys


def test_lines_with_one_label_meet_others_only():
    rng = np.random.default_rng(7)
    line = bytes(rng.integers(97, 123, 300).tolist())
    lines = [edited(rng, line, 3) for _ in range(40)]
    ids, size = np.arange(40), np.array([len(x) for x in lines], np.int32)
    label = np.where(ids < 38, 0, ids)
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(label), pa.array(size), pa.array(lines, pa.binary())], ["id", "label", "size", "normal"])
    blobs = [x for found in line_dedup._keys(0.9, _Even, 0, 1 << 40, 1, 0, 1)([batch]) for x in found["rows"].to_pylist()]
    out = line_dedup._close(0.9, None, 0, 1 << 40)(pa.table({"rows": pa.array(blobs, pa.binary())})).to_pylist()
    assert {tuple(sorted(p.values())) for p in out} == {(a, b) for b in (38, 39) for a in range(b)}


@pytest.mark.parametrize("least", [0.9, 0.8])
def test_many_pairs_are_verified_as_each(least):
    rng = np.random.default_rng(11)
    one = [bytes(rng.integers(97, 101, rng.integers(1, 400)).tolist()) for _ in range(1500)]
    other = [edited(rng, x, rng.integers(0, max(2, len(x) // 7))) for x in one]
    want = [line_dedup.similar(a, b, least) for a, b in zip(one, other, strict=True)]
    assert any(want) and not all(want) and line_dedup.all_similar(one, other, least).tolist() == want


def test_similar_lines_meet_in_every_range_of_lengths():
    """Edits spread evenly, as many as there may be: lengths from the first that can have one."""
    rng = np.random.default_rng(13)
    lines = []
    for n in [*range(10, 130), 200, 351, 1000, 3000]:
        line = bytes(rng.integers(97, 123, n).tolist())
        other = bytearray(line)
        for at in np.linspace(0, n - 1, n // 10 + 2).astype(int)[1:-1]:
            other[at] = 48
        lines += [line, bytes(other)]
    ranges = [(0, 30, 1, 0), (30, 64, 2, 0), (30, 64, 2, 1), (64, 1 << 40, 1, 0)]
    met = set()
    for lower, upper, slices, rest in ranges:
        blobs = _keys_of(lines, lower=lower, upper=upper, slices=slices, rest=rest)
        out = line_dedup._close(0.9, None, lower, upper)(pa.table({"rows": pa.array(blobs, pa.binary())}))
        met |= {tuple(sorted(p.values())) for p in out.to_pylist()}
    assert {(i, i + 1) for i in range(0, len(lines), 2) if line_dedup.similar(lines[i], lines[i + 1])} <= met and len(lines) // 2 <= len(met)
