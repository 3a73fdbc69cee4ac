"""The contracts once more in plain Python, row by row, and small tables with every odd case."""

import collections
import hashlib
import re

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text):
    return [w for w in SPACES.split(text or "") if w]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


PROSE = [f"w{i % 7}x{i * i % 101} on the {i % 13} way to {i * 7 % 89}" for i in range(60)]


def long(a, b):
    return " ".join(PROSE[a:b])


def odd_documents(spark):
    """NULLs in every column, empty and blank texts, ties, repeated rows, a long text, columns of clashing names."""
    rows = [
        (1, long(0, 12), "en", "s", 0), (2, long(0, 12), "en", "s", 1), (2, long(0, 12), "en", "s", 2), (3, long(0, 12) + " end", None, "s", 3),
        (4, long(12, 40), "de", None, 4), (5, long(12, 40).upper(), "de", "s", 5), (6, "pre " + long(14, 40), "de", "s", 6), (7, None, "en", "s", 7), (8, "", "en", "s", 8),
        (9, " \t\n ", "en", "s", 9), (10, "one two", "en", "s", 10), (11, "One  two", "en", "s", 11), (None, long(12, 40), "de", "s", 12), (None, None, None, None, None),
        (12, "same " * 30 + "\n" + long(40, 60), "en", "s", 13), (13, "same " * 30 + "\n" + long(41, 60), "en", "s", 14), (14, "é日本 ▁ 😀 x\x00y\r\nz", "xx", "s", 15),
        (15, (long(0, 60) + "\n") * 40, "en", "s", 16), (16, "x" * 500, "en", "s", 17), (10, "another text of the same name", "en", "s", 18),
    ]
    return spark.createDataFrame(
        [(i, t, lang, s, n, n, 0.5, "c", n) for i, t, lang, s, n in rows],
        "doc_id long, text string, lang string, source string, n_words long, row long, score double, keep_id string, component long",
    )


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


def exact(docs):
    groups = collections.defaultdict(list)
    for i, t in docs:
        groups[sha(SPACES.sub("", t or ""))].append((-len(t or ""), i is None, i))
    out = []
    for i, t in docs:
        h = sha(SPACES.sub("", t or ""))
        best = min(groups[h], key=lambda x: (x[0], x[1], x[2] or 0))
        out.append((i, best[2], len(groups[h]), (-len(t or ""), i is None, i) == best, h))
    return out


def jaccard(docs):
    sets = []
    for _, t in docs:
        w = words(lower(t or ""))
        sets.append(frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset())
    group = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 75 * len(sets[a] | sets[b]) and sets[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    out = []
    for k, (i, _) in enumerate(docs):
        named = [docs[j][0] for j in range(len(docs)) if group[j] == group[k] and docs[j][0] is not None]
        out.append((i, len(sets[k]), (min(named) if named else None) if sets[k] else i))
    return out


def phrases(docs):
    first = {}
    for i, t in sorted(((i, t) for i, t in docs if i is not None), key=lambda d: d[0]):
        w = words(t)
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    out = []
    for i, t in docs:
        w = words(t)
        gone = set()
        for j in range(len(w) - 12):
            if i is not None and first[tuple(w[j : j + 13])] < i:
                gone |= set(range(j, j + 13))
        out.append((i, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return out


def benchmark(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = word.findall(lower(t or ""))
        for j in range(max(1, len(w) - 9)):
            if w:
                windows[tuple(w[j : j + 10])].add(i)
    out = []
    for i, t in docs:
        w = word.findall(lower(t or ""))
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    found |= windows[tuple(w[j : j + n])]
        found = {str(x) for x in found if x is not None}
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out
