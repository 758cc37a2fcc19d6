"""Spelling variants, importance resampling and repeated passages against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corvane.llm.importance import features, importance_resample
from corvane.llm.spelling import slipped, spelling_variants
from corvane.llm.substring_dedup import packed, rolling, unpacked, without_repeats


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


# spelling variants


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def spelled(docs, length, least, factor):
    n = Counter()
    for ident, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            n[run if h % 199 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    n = {w: c for w, c in n.items() if len(w) >= length and c >= least}
    links = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, vs in links.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(links[w]), n[form[w]] if form[w] else None)
    return out


def check_spelling(spark, docs, length=3, least=1, factor=2):
    rows = spark.createDataFrame(docs, "doc_id long, text string, word string, n int, _w int")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants(rows, least_length=length, least_count=least, factor=factor).collect()}
    assert got == spelled([d[:2] for d in docs], length, least, factor)


def test_spelling_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    stems = ["aaa", "aaaa", "aaab", "abab", "ababa", "bbba", "abcabc", "éabc", "éabd", "cabcab", "acb"]
    words = set(stems)
    for s in stems:  # several edits deep, over a small alphabet: many shared prefixes, repeated letters, words that end at nodes
        for _ in range(25):
            w = list(s)
            for _ in range(rng.integers(1, 4)):
                i = rng.integers(0, len(w))
                w[i:i + rng.integers(0, 2)] = [str(x) for x in rng.choice(list("abcé"), rng.integers(0, 2))]
                w = w or ["a"]
            words.add("".join(w))
    words = sorted(words)
    often = {w: int(2 ** rng.integers(0, 9)) for w in words}
    docs = [(i, " ".join([w] * often[w]) + ".", "x", 1, 2) for i, w in enumerate(words)]
    check_spelling(spark, docs)


def test_spelling_follows_chains_of_forms(spark):
    docs = [(1, "colour " * 1, "x", 0, 0), (2, "colours " * 5, "x", 0, 0), (3, "coloursy " * 25, "x", 0, 0), (4, "zcoloursy " * 125, "x", 0, 0)]
    check_spelling(spark, docs, 6, 1, 5)
    rows = spelling_variants(spark.createDataFrame(docs, "doc_id long, text string, word string, n int, _w int"), least_count=1).collect()
    assert {r.root for r in rows} == {"zcoloursy"}


def test_spelling_of_nulls_nothing_and_repeats(spark):
    docs = [(None, "Tree TREE trees", "x", 0, 0), (1, None, "x", 0, 0), (2, "", "x", 0, 0), (3, "tree-trees", "x", 0, 0), (3, "tree-trees", "x", 0, 0)]
    check_spelling(spark, docs)
    assert spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_run_slips_by_its_checksum():
    run = next(f"word{'a' * i}" for i in range(4000) if zlib.crc32(f"7:word{'a' * i}".encode()) % 199 == 0)
    h = zlib.crc32(f"7:{run}".encode())
    assert slipped("7", run) == run[:h % len(run)] + run[h % len(run) + 1:]
    assert slipped("8", "words") == ("words" if zlib.crc32(b"8:words") % 199 else "")


# importance resampling


def grams(text):
    w = [x for x in re.split("[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+", lower(text or "")) if x]
    return w, [" ".join(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def resampled(docs, target, buckets, percent, least, seed=42):
    code = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(map(code, grams(x)[1]))
    for x in target:
        t.update(map(code, grams(x)[1]))
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * (sum(s.values()) + buckets)) / ((s[b] + 1) * (sum(t.values()) + buckets))))
    out = []
    for ident, x in docs:
        w, f = grams(x)
        h = int(hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(code(g)) for g in f)
        out.append([ident, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296.0))), None, len(w)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for i, r in enumerate(able[:len(able) * percent // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("percent", [0, 30, 100])
def test_resampling_equals_brute_force(spark, percent):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(40)] + ["Été", "x-Y", "A9"]
    docs = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 30)))) for i in range(120)]
    docs += [(200 + i, docs[0][1]) for i in range(40)] + [(None, docs[1][1]), (500, None), (501, ""), (7, docs[7][1])]
    target = [" ".join(rng.choice(vocabulary[:8], 20)) for _ in range(5)] + [None]
    rows = spark.createDataFrame([(*d, 1, b"x", 5) for d in docs], "doc_id long, text string, weight int, digest binary, rank int")
    aim = spark.createDataFrame([(x,) for x in target], "text string")
    got = importance_resample(rows, aim, buckets=97, percent=percent, least_words=5)
    assert [c for c, t in got.dtypes if t == "bigint"] == ["doc_id", "n_features", "weight", "score", "rank"] == got.columns
    assert sorted((tuple(r) for r in got.collect()), key=repr) == resampled(docs, target, 97, percent, 5)


def test_resampling_of_nothing(spark):
    docs = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    none = docs.where("false")
    assert importance_resample(none, docs).count() == 0
    assert [r.n_features for r in importance_resample(docs, none).collect()] == [6]


def test_features_of_a_very_long_text_are_those_of_its_runs(monkeypatch):
    monkeypatch.setattr("corvane.llm.importance.CHUNK", 64)  # words go on from piece to piece
    text = " ".join(f"Wort{i % 37},{'y' * (i % 90)}" for i in range(800))
    w, f = grams(text)
    n_words, n, at, counts = features(text.encode(), 1000)
    want = Counter(zlib.crc32(g.encode()) % 1000 for g in f)
    assert (n_words, n, dict(zip(at.tolist(), counts.tolist()))) == (len(w), len(f), dict(want))


# repeated passages


def deduplicated(docs, window):
    words = {i: re.findall("[^ \\t-\\r]+", x or "") for i, x in docs}
    first = {}
    for i in sorted(words):
        for s in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][s:s + window]), (i, s))
    out = {}
    for i, w in words.items():
        gone = {s + k for s in range(len(w) - window + 1) if first[tuple(w[s:s + window])] != (i, s) for k in range(window)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


@pytest.mark.parametrize("window", [20, 5, 2])
def test_repeats_equal_brute_force(spark, window):
    rng = np.random.default_rng(6)
    fresh = lambda n: [f"u{rng.integers(10**9)}" for _ in range(n)]
    passages = [fresh(n) for n in (window, window + 1, 3 * window, window - 1, 60)]
    docs = []
    for i in range(60):  # passages at every offset, next to each other, cut, within one text twice
        w = fresh(rng.integers(0, 15))
        for _ in range(rng.integers(0, 4)):
            p = passages[rng.integers(len(passages))]
            w += p[rng.integers(0, 3):len(p) - rng.integers(0, 3)] + fresh(rng.integers(0, 3))
        docs.append((i * 7, rng.choice([" ", "\t", " \n "]).join(w)))
    docs += [(1000, "la " * 400), (1001, "la " * 90 + "end"), (1002, None), (1003, ""), (1004, docs[3][1]), (-5, docs[9][1]), (1005, "a b " * 100)]
    rows = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, row int, starts string").repartition(5)
    got = without_repeats(rows, window=window, texts_too=True)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in got.collect()} == deduplicated(docs, window)


def test_repeats_over_many_groups_and_cells(spark, monkeypatch):
    monkeypatch.setattr("corvane.llm.substring_dedup.GROUP_ROWS", 3)
    monkeypatch.setattr("corvane.llm.substring_dedup.CELL_WORDS", 50)
    rng = np.random.default_rng(8)
    shared = [f"s{i}" for i in range(45)]
    docs = [(i, " ".join([f"u{rng.integers(10**9)}" for _ in range(rng.integers(0, 25))] + shared[rng.integers(0, 20):])) for i in range(50)]
    got = without_repeats(spark.createDataFrame(docs, "doc_id long, text string"), texts_too=True)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in got.collect()} == deduplicated(docs, 20)


def test_repeats_of_repeated_rows_null_ids_and_nothing(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = spark.createDataFrame([(4, text), (4, text), (None, text), (9, text)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.n_removed) for r in without_repeats(rows).collect()) == [(-1, 30), (4, 0), (4, 0), (9, 30)]
    assert without_repeats(rows.where("false")).count() == 0


def test_hashes_pack_and_roll():
    values = np.array([0, 1, (1 << 40) - 1, 123456789012], dtype=np.uint64)
    assert unpacked(packed(values)).tolist() == values.tolist()
    hashes = np.arange(1, 30, dtype=np.uint64)
    again = np.r_[hashes, hashes]
    assert rolling(again, 7)[:23].tolist() == rolling(again, 7)[29:].tolist() and len(rolling(hashes, 30)) == 0
