import random

import xxhash

from corvane.llm.common import ship
from corvane.llm.simhash import drop_near_duplicates, near_duplicate_components, fingerprint, fingerprint_links, plan_partitions, simhash_components


def slow_print(text, k):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(pairs, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_fingerprints():
    for t in [None, "", "  ", "one", "One two three four", "a b c d e f A B C D", "é É x y z w", "a\x1cb c\x85d e f g", "x " * 9000]:
        assert fingerprint(t, 4) == slow_print(t, 4), t


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def make_prints(n, seed):
    rng = random.Random(seed)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    out = {0}
    while len(out) < n:
        x = rng.choice(seeds)
        for b in rng.sample(range(64), rng.randrange(0, 7)):
            x ^= 1 << b
        out.add(x)
    return sorted(out)


def test_links_lose_no_pair_at_any_size_of_group(spark):
    prints = make_prints(400, 5)
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    close = [(signed(a), signed(b)) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 4]
    want = components(close, [signed(p) for p in prints])
    for hot in (4096, 5):
        links = [(r.src, r.dst) for r in fingerprint_links(frame, 4, hot).collect()]
        got = components(links, [signed(p) for p in prints])
        assert got == want


def test_plan_meets_the_pigeonhole_bound():
    import numpy as np

    plan = plan_partitions(np.array(make_prints(300, 1), np.uint64), 10**9, 4)
    bits = sorted(b for g, _ in plan for b in g)
    assert len(bits) == len(set(bits)) and sum(r + 1 for _, r in plan) == 5


def test_components(spark):
    ship(spark)
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base), (3, base + " x"), (9, base), (9, base), (7, "other words entirely here and more of them"), (4, None), (2, ""), (8, "   "), (None, base), (6, "y " * 4000)]
    got = sorted(((r.doc_id, r.component_id) for r in simhash_components(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()), key=str)
    fps = {t: slow_print(t, 4) for _, t in rows}
    assert (fps[base] ^ fps[base + " x"]).bit_count() <= 4
    assert got == sorted([(5, 3), (3, 3), (9, 3), (9, 3), (7, 7), (4, 2), (2, 2), (8, 2), (None, 3), (6, 6)], key=str)
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_of_each_group_stays_and_columns_too(spark):
    base = " ".join(f"w{i}" for i in range(400))
    docs = spark.createDataFrame([(5, base, 1), (3, base, 2), (3, base, 2), (7, "z", 3), (None, "q r s", 4)], "doc_id long, text string, fp int")
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.fp) for r in kept.collect()), key=str) == sorted([(3, 2), (7, 3), (None, 4)], key=str)


def test_texts_of_similarity_from_four_fifths_on_are_linked(spark):
    ship(spark)
    rng, rows, groups = random.Random(8), [], []
    for g in range(25):
        base = [f"w{rng.randrange(4000)}" for _ in range(300)]
        own = [" ".join(base)]
        for edits in (1, 3, 5, 6):
            copy = list(base)
            for i in rng.sample(range(300), edits):
                copy[i] = f"x{rng.randrange(4000)}"
            own.append(" ".join(copy))
        groups.append(range(len(rows), len(rows) + len(own)))
        rows += own
    sets = [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, rows)]
    pairs = [(i, j) for g in groups for i in g for j in g if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    got = {r.doc_id: r.component_id for r in near_duplicate_components(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.95 * len(pairs)
    assert all(got[i] in groups[k] for k, g in enumerate(groups) for i in g)
    assert near_duplicate_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_components(rows):
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, rows)]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    return components(pairs, range(len(rows)))


def near_components(spark, rows):
    ship(spark)
    return {r.doc_id: r.component_id for r in near_duplicate_components(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}


def scattered_copies(seed, n=100, words=300, edits=6):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(4000)}" for _ in range(words)]
    rows = []
    for _ in range(n):
        copy = list(base)
        for i in rng.sample(range(words), edits):
            copy[i] = f"x{rng.randrange(4000)}"
        rows.append(" ".join(copy))
    return [*rows, " ".join(base)]


def test_copies_like_their_base_only_are_one_group(spark):
    rows = scattered_copies(1) + scattered_copies(2, 50, 100, 2)
    assert near_components(spark, rows) == brute_components(rows)


def extended_copies(seed, n=60):
    rng, rows = random.Random(seed), []
    for k in range(n):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice((40, 100, 300)))]
        more = [f"x{rng.randrange(4000)}" for _ in range(len(base) * (k % 3 + 1) // 15)]
        rows += [" ".join(base), " ".join(base + more), " ".join(base[: len(base) - len(more)])]
    return rows


def test_extended_and_truncated_copies_are_linked(spark):
    rows = extended_copies(3)
    assert near_components(spark, rows) == brute_components(rows)


def reordered_copies(seed, n=30):
    rng, rows = random.Random(seed), []
    for _ in range(n):
        words = [f"w{i}" for i in rng.sample(range(4000), 150)]
        for _ in range(4):
            rng.shuffle(words)
            near = list(words)
            near[70], near[71] = near[71], near[70]
            rows += [" ".join(words), " ".join(near)]
    return rows


def test_near_copies_among_texts_of_the_same_words_in_other_order_are_linked(spark):
    rows = reordered_copies(4)
    assert near_components(spark, rows) == brute_components(rows)


def line_sharers(seed, n=20):
    rng, rows = random.Random(seed), []
    for k in range(n):
        line = [f"l{k}x{i}" for i in range(12)]
        rows += [" ".join([f"w{rng.randrange(10**6)}" for _ in range(600)] + line * 100) for _ in range(2)]
    return rows


def test_a_line_repeated_often_does_not_link_different_texts(spark):
    rows = line_sharers(5)
    assert set(near_components(spark, rows).items()) == set(enumerate(range(len(rows))))


def just_apart(seed, n=150):
    rng, rows = random.Random(seed), []
    for _ in range(n):
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        more = [f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(60, 120))]
        rows += [" ".join(base), " ".join(base + more)]
    return rows


def test_long_texts_are_told_apart_by_their_whole_sets(spark):
    rows = just_apart(6)
    assert near_components(spark, rows) == brute_components(rows)


def test_cells_join_the_components_whose_sets_are_similar(spark, monkeypatch):
    import numpy as np

    from corvane.llm import simhash
    from corvane.llm.components import connected_components

    monkeypatch.setattr(simhash, "BLOCK_TEXTS", 5)
    monkeypatch.setattr(simhash, "MATRIX", 200)
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**63), 2**63 - 1, 60)
    sets = {i: np.unique(np.r_[rng.choice(base, 56, False), rng.integers(-(2**63), 2**63 - 1, 1 + i % 4)]) for i in range(40)}
    root = {i: 0 if i < 12 else 30 if i in (30, 31) else i for i in sets}
    keys = {7: list(range(40)), 8: [0, 1, 20], 9: [33, 34]}
    members = [(k, i, root[i], max(set(root[i] for i in at), key=lambda r: (sum(root[i] == r for i in at), r))) for k, at in keys.items() for i in at]
    links = simhash.open_links(
        spark.createDataFrame(members, "key long, x long, root long, home long"),
        spark.createDataFrame([(i, s.tolist()) for i, s in sets.items()], "digest long, hashes array<long>"),
        0.8,
    ).collect()
    jaccard = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    like = {(i, j) for i in sets for j in sets if i < j and root[i] != root[j] and jaccard(sets[i], sets[j]) >= 0.8}
    assert 20 < len(like) < 600

    def groups(pairs):
        found = connected_components(spark.createDataFrame([*pairs, *((i, r) for i, r in root.items())], "src long, dst long"))
        return {r.node: r.root for r in found.collect()}

    assert groups([(r.src, r.dst) for r in links]) == groups(like)
    assert all(i in sets and j in sets for i, j in ((r.src, r.dst) for r in links))


def test_frames_of_a_key_that_spans_batches_stay_whole():
    import pandas as pd

    from corvane.llm.simhash import runs

    rows = pd.DataFrame({"k": [1, 1, 2, 2, 2, 3], "a": [0, 0, 0, 0, 1, 1], "x": range(6)})
    for size in range(1, 7):
        batches = [rows.iloc[i : i + size] for i in range(0, 6, size)]
        assert [f["x"].tolist() for f in runs(iter([rows.iloc[:0], *batches]), ["k", "a"])] == [[0, 1], [2, 3], [4], [5]]
    assert list(runs(iter([]), ["k"])) == []
