"""Merkle manifest, periodic runs and packing against brute force, on every odd case."""

import collections
import hashlib
import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fairfold.llm import merkle, packing, periodic, queries

from . import brute

PATH = public_tokenizers.path(packing.TOKENIZER)


@pytest.fixture(scope="module")
def docs(spark):
    return brute.odd_documents(spark).withColumn("n_chars", F.char_length("text").cast("long")).withColumns({c: F.lit(c) for c in ("tree", "pos", "path", "runs")}).cache()


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, i):
    out = []
    for level in tree[:-1]:
        run = i - i % 3
        out.append(("".join(level[run:i]), "".join(level[i + 1 : run + 3])))
        i //= 3
    return out


def manifest(rows):
    """Rows of (doc_id, source, lang, n_chars, text)."""
    of = collections.defaultdict(list)
    for r in rows:
        of[r[1]].append((r[0] is not None, r[0] or 0, leaf(*r), r))
    names = sorted(of, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(of[s], key=lambda x: x[:3])]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for n, s in enumerate(names):
        for i, (_, _, own, r) in enumerate(sorted(of[s], key=lambda x: x[:3])):
            path = siblings(trees[s], i) + siblings(top, n)
            acc, text = own, r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
                acc = leaf(*r[:4], text.replace("\n", ""))
            for left, right in path:
                acc = sha(left, acc, right)
            out.append((r[0], own, trees[s][-1][0], top[-1][0], sha(*(a + b for a, b in path)), acc, acc == top[-1][0]))
    return out


def written(spark, folder, df):
    df.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("levels_of_a_block", [5, 1])
def test_manifest(spark, docs, tmp_path, monkeypatch, levels_of_a_block):
    monkeypatch.setattr(merkle, "LEVELS", levels_of_a_block)
    monkeypatch.setattr(merkle, "WIDTH", 3**levels_of_a_block)
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    many = spark.range(300).selectExpr("id + 100 doc_id", "concat('line ', id, '\\nend') text", "'en' lang", "if(id < 250, 'big', concat('s', id)) source", "id n_chars")
    table = docs.select(*columns).unionByName(many)
    got = queries.op11(spark, written(spark, tmp_path, table.withColumn("tree", F.lit(1)))).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert brute.in_order(got) == brute.in_order(manifest([tuple(r) for r in table.select(*columns).collect()]))
    assert {r["verified"] for r in got} == {True, False}


def test_manifest_of_many_equal_rows(spark):
    table = spark.range(700).selectExpr("cast(null as long) doc_id", "'s' source", "'en' lang", "1 n_chars", "'same' text").repartition(3)
    got = merkle.manifest(table).collect()
    own = leaf(None, "s", "en", 1, "same")
    assert len(got) == 700 and {r["leaf"] for r in got} == {own} and {r["root"] for r in got} == {levels([own] * 700)[-1][0]}
    assert merkle.manifest(table.limit(0)).count() == 0


def all_runs(words, least=24, repeats=3):
    n, out = len(words), {}
    for q in range(1, n // repeats + 1):
        same = [words[i] == words[i + q] for i in range(n - q)]
        i = 0
        while i < len(same):
            if same[i]:
                j = i
                while j < len(same) and same[j]:
                    j += 1
                length = j - i + q
                if length >= max(least, repeats * q):
                    out.setdefault((i, length), q)  # a smaller period came first
                i = j
            i += 1
    return sorted((s, n, q) for (s, n), q in out.items())


@pytest.mark.parametrize(("least", "repeats"), [(24, 3), (6, 3), (1, 3), (10, 5)])
def test_runs_of_random_words(least, repeats):
    rng = np.random.default_rng(least)
    for k in range(150):
        parts = []
        for _ in range(rng.integers(1, 5)):
            own = rng.integers(0, 3, rng.integers(1, 30)).tolist()
            parts += own * int(rng.integers(1, 7)) + own[: rng.integers(0, len(own) + 1)]
            if k % 2:
                parts[rng.integers(len(parts))] = 9
        got = periodic.find_runs(np.array(parts), least, repeats)
        assert got == sorted(all_runs(parts, least, repeats), key=lambda r: (r[0], r[2]))


def repeated(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def run_digest(doc_id, text):
    words = repeated(doc_id, brute.words(text))
    runs = sorted(all_runs(words), key=lambda r: (r[0], r[2]))
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(*(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_periodic_runs(spark, docs, tmp_path):
    more = [(200 + i, brute.long(i % 30, 60)) for i in range(80)] + [(400, "a " * 90), (401, "x " + "a b " * 12 + "a"), (402, "a b c " * 8), (403, "a b c " * 7 + "a b")]
    table = docs.select("doc_id", "text", "runs").unionByName(spark.createDataFrame(more, "doc_id long, text string").withColumn("runs", F.lit("r")))
    got = queries.op12(spark, written(spark, tmp_path, table)).collect()
    assert brute.in_order(got) == brute.in_order(run_digest(i, t) for i, t in brute.pairs(table))
    assert sum(r["n_runs"] > 0 for r in got) > 8


def test_runs_of_long_texts(spark):
    one = "la " * 400_000
    two = " ".join(f"w{i % 70_001}" for i in range(300_000))
    got = {r["doc_id"]: r for r in periodic.periodic_runs(spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")).collect()}
    assert (got[1]["start"], got[1]["length"], got[1]["period"], got[1]["kept_text"]) == (0, 400_000, 1, "la")
    assert (got[2]["start"], got[2]["length"], got[2]["period"]) == (0, 300_000, 70_001) and len(got[2]["runs"]) == 1


def check_packed(rows, pairs, capacity):
    """Every id in exactly one piece, sequences without gaps; the places that padding takes."""
    tokenizer = Tokenizer.from_file(PATH)
    want = collections.Counter()
    for i, t in pairs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want[i, tuple(ids)] += 1
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], ids))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for (i, ids), n in want.items():
        spans = sorted(pieces[i, len(ids)], key=lambda p: p[0])
        covered = np.zeros(len(ids), int)
        for start, own in spans:
            covered[start : start + len(own)] += 1
        same = sum(m for (j, other), m in want.items() if j == i and len(other) == len(ids))
        assert (covered == same).all()
        if same == n:
            assert all(list(ids[s : s + len(own)]) == own for s, own in spans)
    assert set(pieces) == {(i, len(ids)) for i, ids in want}
    padding = 0
    for spans in sequences.values():
        place = 0
        for offset, length in sorted(spans):
            assert offset == place
            place += length
        assert place <= capacity
        padding += 0 if place & (place - 1) == 0 else capacity - place
    return padding, len(sequences)


@pytest.mark.parametrize("capacity", [1024, 100, 16])
def test_packing(spark, docs, capacity):
    more = spark.createDataFrame([(500 + i, brute.long(i % 50, i % 50 + 1 + i % 9)) for i in range(120)] + [(700, "tell <|endoftext|>  <|endoftext|> x")], "doc_id long, text string")
    table = docs.select("doc_id", "text", "pos").unionByName(more.withColumn("pos", F.lit("p"))).repartition(5)
    padding, _ = check_packed(packing.packed(table, PATH, capacity).collect(), brute.pairs(table), capacity)
    assert padding == 0
    assert packing.packed(table.limit(0), PATH, capacity).count() == 0


def test_packing_of_equal_lengths(spark):
    """No pattern fits: all but a few of one length that does not divide a sequence."""
    table = spark.range(3000).selectExpr("id doc_id", "repeat(' word', 599) text").repartition(6)
    rows = packing.packed(table, PATH).collect()
    padding, sequences = check_packed(rows, brute.pairs(table), 1024)
    assert padding == 0 and sequences <= 3000 * 600 // 1024 + 11


def test_packing_plan_uses_patterns():
    rng = np.random.default_rng(4)
    demand = collections.Counter(rng.integers(1, 1024, 20_000).tolist())
    made = packing.plan(dict(demand))
    tokens = sum(n * k for n, k in demand.items())
    assert made.full <= 0.1 * tokens / 1024 and made.first >= 0.9 * tokens / 1024
    taken = collections.Counter()
    for n, lo, hi, *_ in made.ranges:
        assert taken[n] == lo < hi
        taken[n] = hi
    assert taken == demand


def test_column_generation_finds_patterns_that_the_start_misses():
    for demand, capacity in (({44: 30, 33: 40}, 132), ({60: 10, 40: 30, 30: 10}, 100), ({60: 10, 45: 7, 30: 9}, 100), ({50: 9, 31: 8, 27: 5}, 100)):
        cost = packing._cost(capacity)
        found, _ = packing.patterns(demand, capacity)
        for n, k in demand.items():
            assert np.isclose(sum(p.counts.get(n, 0) * p.times for p in found), k)
        start = packing._first_patterns(demand, cost, capacity)
        price = sum(cost[sum(n * k for n, k in p.counts.items())] * p.times for p in found)
        assert sum(n * k for n, k in demand.items()) - 1e-6 <= price <= sum(cost[sum(n * k for n, k in c.items())] * t for c, t, _ in start) + 1e-6
        # no pattern at all saves anything at the end's prices
        assert np.isclose(price, _least(demand, capacity, cost), rtol=2e-4)


def _least(demand, capacity, cost):
    """The least price of whole and fractional patterns, by weak duality: ascent of the prices over all patterns."""
    lengths = sorted(demand)
    patterns = []

    def grow(at, counts, size):
        if size:
            patterns.append(([counts.get(n, 0) for n in lengths], cost[size]))
        for k in range(at, len(lengths)):
            if size + lengths[k] <= capacity:
                grow(k, {**counts, lengths[k]: counts.get(lengths[k], 0) + 1}, size + lengths[k])

    grow(0, {}, 0)
    a, c = np.array([p for p, _ in patterns], float), np.array([x for _, x in patterns])
    b = np.array([demand[n] for n in lengths], float)
    # tokens are a lower bound, and each vertex of the dual that the patterns allow a better one
    best = float(b @ lengths)
    for chosen in itertools.combinations(range(len(patterns)), len(lengths)) if len(patterns) < 40 else ():
        m = a[list(chosen)]
        if abs(np.linalg.det(m)) > 1e-9:
            y = np.linalg.solve(m, c[list(chosen)])
            if (a @ y <= c + 1e-7).all():
                best = max(best, float(b @ y))
    return best


def test_encoder_equals_the_tokenizer(spark, sf):
    rng = np.random.default_rng(6)
    marks = [*" \t\n\r\x0b\x0c\x1c\x85\xa0  　ab'sZ9.é日😀-<|", "<|endoftext|>", "  ", " a", " '"]
    common = [*" \t\n\rab'sZ9.éßñ-<|!", "  ", " a", " '", "\n\n", "'ll"]
    texts = ["".join(m[i] for i in rng.integers(0, len(m), rng.integers(0, 30))) for m in (marks, common) for _ in range(5000)]
    texts += [r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + ["x" * 20_000, "ab" * 5_000 + " " * 5_000 + "\n" * 3_000]
    tokenizer, encode = Tokenizer.from_file(PATH), packing.Encoder(PATH)
    assert encode.fast is not None
    for how in (encode, encode.by_pieces):
        for lo in range(0, len(texts), 500):
            some = texts[lo : lo + 500]
            for t, ids in zip(some, how([t.encode() for t in some]), strict=True):
                assert tokenizer.encode(t, add_special_tokens=False).ids == np.frombuffer(ids, "<u4").tolist(), t
