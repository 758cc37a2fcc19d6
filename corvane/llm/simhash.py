"""SimHash near-duplicates, found by the generalised pigeonhole principle; near-duplicates by the similarity of shingle sets."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, local, release, settled, thin, unsent, unused
from .components import connected_components, near_labels

BITS = 64
#: Fingerprints that the plan looks at, about. The plan sets the cost only; every plan finds every pair.
PLAN_SAMPLE = 8192
#: Seconds for writing and shuffling one probe and for verifying one candidate pair, for the plan's comparison.
PROBE_S, CANDIDATE_S = 1e-6, 5e-8
#: Texts, and shingles of all its texts, that a block of a band's texts holds, about.
BLOCK_TEXTS, BLOCK_SHINGLES = 2048, 1 << 21
#: Entries of the matrix of texts by shingles that a comparison holds at once.
MATRIX = 1 << 22
#: Bits of the map of wanted texts, a power of two.
MAP_BITS = 1 << 23


def text_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: only A-Z and ASCII white space count


def shingle_hashes(words: list[bytes], shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of `shingle` words, joined by spaces; of all words if there are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    stops = (ends[len(words) - n :] - 1).tolist()
    one = partial(xxhash.xxh64_intdigest, seed=seed)
    return np.fromiter((one(joined[a:b]) for a, b in zip(starts, stops, strict=True)), np.uint64, n)


def majority_bits(hashes: np.ndarray) -> int:
    """64 bits, each set if set in over half the hashes; 0 without any."""
    n, set_bits = len(hashes), np.zeros(BITS, np.int64)
    for i in range(0, n, 4096):
        block = hashes[i : i + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(block, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > n).tobytes(), "big")


def fingerprint(text: str | None, shingle: int, seed: int = 42) -> int:
    """The majority bits of a text's shingles, repeats included."""
    return majority_bits(shingle_hashes(text_words(text), shingle, seed))


def fingerprint_column(text: Column, shingle: int = 5) -> Column:
    """The fingerprint as a signed long (the same 64 bits)."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return of(text)


def radius_chance(differ: np.ndarray, radius: int) -> float:
    """Chance that at most radius of some bits differ, each differing with its own chance."""
    chance = np.zeros(radius + 1)
    chance[0] = 1.0
    for p in differ:
        chance[1:] = chance[1:] * (1 - p) + chance[:-1] * p
        chance[0] *= 1 - p
    return float(chance.sum())


def group_bits(sample: np.ndarray, m: int) -> list[list[int]]:
    """m groups of bits, sizes as even as they can be: each takes the free bit most correlated with its members.

    Correlated bits in one group leave the groups nearly independent, so that a group's chance collisions do not repeat
    in the others.
    """
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    bits -= bits.mean(0)
    scale = np.sqrt((bits**2).sum(0))
    scale[scale == 0] = 1.0
    near = np.abs((bits / scale).T @ (bits / scale))
    free, groups = set(range(BITS)), []
    for g in range(m):
        size = BITS // m + (g < BITS % m)
        rest = sorted(free)
        group = [rest[int(near[np.ix_(rest, rest)].sum(1).argmax())]]
        free.discard(group[0])
        while len(group) < size:
            rest = sorted(free)
            group.append(rest[int(near[np.ix_(rest, group)].sum(1).argmax())])
            free.discard(group[-1])
        groups.append(sorted(group))
    return groups


def plan_partitions(sample: np.ndarray, n: int, threshold: int, sizes: range = range(2, 7)) -> list[tuple[list[int], int]]:
    """(bits, radius) of each partition that is probed.

    Pairs within `threshold` bits agree up to radius_i in some partition i, if the radii add up to threshold - m + 1
    (radius -1: not probed). For each m, dynamic programming over the partitions finds the radii of least cost: probes
    written, and candidate pairs estimated from how often the sample's bits differ. The cheapest m wins.
    """
    if len(sample) < 2:
        sample = np.array([0, 1], np.uint64)
    ones = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).mean(0)
    differ = 2 * ones * (1 - ones)
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for m in sizes:
        groups = group_bits(sample, m)
        costs = {}
        for i, group in enumerate(groups):
            costs[i, -1] = 0.0
            for r in range(threshold + 1):
                probes = sum(comb(len(group), k) for k in range(r + 1))
                costs[i, r] = PROBE_S * n * (1 + probes) + CANDIDATE_S * n * n * radius_chance(differ[group], r)
        reach: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}  # sum of radii + 1 so far -> cost, radii
        for i in range(m):
            step: dict[int, tuple[float, list[int]]] = {}
            for used, (cost, radii) in reach.items():
                for r in range(-1, threshold + 1):
                    if used + r + 1 <= threshold + 1 and (used + r + 1 not in step or cost + costs[i, r] < step[used + r + 1][0]):
                        step[used + r + 1] = (cost + costs[i, r], [*radii, r])
            reach = step
        cost, radii = reach[threshold + 1]
        if best is None or cost < best[0]:
            best = (cost, [(g, r) for g, r in zip(groups, radii, strict=True) if r >= 0])
    return best[1]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def flips(bits: list[int], radius: int) -> list[int]:
    """Masks (as signed longs) of every choice of at most radius of the bits."""
    return [signed(sum(1 << b for b in chosen)) for k in range(radius + 1) for chosen in combinations(bits, k)]


def flipped(own: Column, masks: list[int]) -> Column:
    """own with each mask's bits flipped, as an array; the masks are one literal in the plan."""
    return F.transform(F.from_json(F.lit(json.dumps(masks)), "array<bigint>"), lambda f: own.bitwiseXOR(f))


def fingerprint_links(prints: DataFrame, threshold: int = 4, hot: int | None = 4096, plan: list[tuple[list[int], int]] | None = None) -> DataFrame:
    """Links (src, dst) that connect what pairs within `threshold` bits connect, of distinct fingerprints `fp`.

    A print stands in each partition under its own bits and asks there under all bits within the partition's radius;
    equal keys meet in a join that verifies the distance, and a pair is given only in the first partition where it meets. Keys under which more than `hot` prints stand would make
    pairs with the square of their number: the prints that stand or ask there are linked instead through the masks of
    at most threshold / 2 flipped bits (two prints within `threshold` share one, and two that share one are within
    `threshold`), each linked to the mask's smallest print, so their work grows in proportion and no link is lost.
    hot=None gives every pair itself, for prints that have no large groups left.
    """
    if hot and threshold % 2:
        raise ValueError("an even threshold is needed")
    if plan is None:
        n = prints.count()
        rows = thin(prints, "fp", PLAN_SAMPLE, n, 1).orderBy("fp").collect()
        plan = plan_partitions(np.array([r[0] for r in rows], np.int64).view(np.uint64), n, threshold)
    stand, ask = [], []
    for i, (bits, radius) in enumerate(plan):
        own = F.col("fp").bitwiseAND(F.lit(signed(sum(1 << b for b in bits))))
        stand.append(F.struct(F.lit(i).alias("part"), own.alias("key")))
        ask.append(F.arrays_zip(F.array_repeat(F.lit(i), len(flips(bits, radius))).alias("part"), flipped(own, flips(bits, radius)).alias("key")))
    standing = prints.select("fp", F.explode(F.array(*stand)).alias("at")).select("fp", "at.*")
    asking = prints.select(F.col("fp").alias("fp2"), F.explode(F.concat(*ask)).alias("at")).select("fp2", F.col("at.part").alias("part2"), F.col("at.key").alias("key2"))
    same = (F.col("part") == F.col("part2")) & (F.col("key") == F.col("key2"))
    crowded = cut(standing.groupBy("part", "key").count().where(F.col("count") > hot).select("part", "key"), "crowded") if hot else None
    found = []
    if crowded and not crowded.isEmpty():
        inside = standing.join(unsent(crowded), ["part", "key"], "left_semi").select("fp")
        inside = inside.unionByName(asking.join(unsent(crowded), same, "left_semi").select(F.col("fp2").alias("fp"))).distinct()
        near = inside.select("fp", F.explode(flipped(F.col("fp"), flips(list(range(BITS)), threshold // 2))).alias("mask"))
        least = near.groupBy("mask").agg(F.min("fp").alias("low")).select(F.col("mask").alias("mask2"), "low")
        found.append(near.join(unsent(least), F.col("mask") == F.col("mask2")).where("fp != low").select(F.col("fp").alias("src"), F.col("low").alias("dst")))
        standing = standing.join(unsent(crowded), ["part", "key"], "left_anti")
    apart = F.col("fp").bitwiseXOR(F.col("fp2"))
    close = F.bit_count(apart) <= threshold
    for i, (bits, radius) in enumerate(plan[:-1]):  # those that meet in an earlier partition come from there
        close = close & ((F.col("part") <= i) | (F.bit_count(apart.bitwiseAND(F.lit(signed(sum(1 << b for b in bits))))) > radius))
    found.append(standing.join(unsent(asking), same & (F.col("fp") < F.col("fp2")) & close).select(F.col("fp").alias("src"), F.col("fp2").alias("dst")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: int = 4, hot: int = 4096) -> DataFrame:
    """One row per row of docs: doc_id, fp (signed long), component_id (smallest doc_id of the component).

    Texts whose fingerprints differ in at most `threshold` bits are linked, at whatever size of group; components are
    taken over the links. Null and empty texts have fingerprint 0, linked like any other. A null id takes part and gets
    the component's smallest id, null if it has none. Copies share one fingerprint, which is linked once.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col), shingle).alias("fp"))
    rows = cut(rows, "prints")
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = connected_components(fingerprint_links(prints.select("fp"), threshold, hot))
    classes = prints.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = cut(classes.join(least, "root").select(F.col("fp").alias("fp2"), "component_id"), "classes")
    return rows.join(classes, F.col("fp") == F.col("fp2")).select("doc_id", "fp", "component_id")


def hex_print(fp: str = "fp") -> Column:
    """16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(shingle_hashes(text_words(text), shingle))


def sliced(batches: Iterator[pd.Series], rows: int = 512) -> Iterator[pd.Series]:
    """The batches in short runs, so that a worker holds the sets of few texts at once."""
    for texts in batches:
        for i in range(0, len(texts), rows):
            yield texts.iloc[i : i + rows]


def set_digest(hashes: np.ndarray) -> int:
    """Equal for equal shingle sets."""
    return xxhash.xxh64_intdigest(hashes.tobytes())


def signed64(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks and odd multipliers of n hash functions over 64-bit hashes, fixed by their numbers."""
    masks = np.array([xxhash.xxh64_intdigest(f"mask {i}") for i in range(n)], np.uint64)
    return masks, np.array([xxhash.xxh64_intdigest(f"factor {i}") | 1 for i in range(n)], np.uint64)


def smallest(hashes: np.ndarray, n: int) -> np.ndarray:
    """The smallest value of a set (not empty) under each of n hash functions: equal for sets of Jaccard J at chance J."""
    masks, factors = permutations(n)
    lows, block = np.full(n, np.iinfo(np.uint64).max, np.uint64), max(1, (1 << 18) // n)
    for i in range(0, len(hashes), block):
        lows = np.minimum(lows, ((hashes[i : i + block, None] ^ masks) * factors).min(0))
    return lows


def band_keys(lows: np.ndarray, bands: int, band_rows: int) -> np.ndarray:
    """One hash per band, of the band's smallest values: equal in a band for sets of Jaccard J at chance J ** band_rows."""
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), seed=i) for i, band in enumerate(lows.reshape(bands, band_rows))], np.uint64)


def text_columns(text: Column, shingle: int, bands: int, band_rows: int) -> Column:
    """Struct of the digest of a text's shingle set, its fingerprint, and the band keys of its set, if not empty."""

    @F.pandas_udf("struct<digest:long,fp:long,keys:array<long>>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in sliced(batches):
            hashes = [shingle_hashes(text_words(t), shingle) for t in texts]
            sets = [np.unique(h) for h in hashes]
            lows = [smallest(s, bands * band_rows) if len(s) else None for s in sets]
            yield pd.DataFrame({
                "digest": signed64(np.array([set_digest(s) for s in sets], np.uint64)),
                "fp": signed64(np.array([majority_bits(h) for h in hashes], np.uint64)),
                "keys": [None if x is None else signed64(band_keys(x, bands, band_rows)) for x in lows],
            })

    return of(text)


def text_key(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def wanted_texts(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """(text) once each, of those whose text_key is in wanted (column tkey), and of few others.

    A bit map of bounded size, made from wanted, leaves out most other texts before anything is shuffled or hashed.
    """
    bit = F.pmod(F.col("tkey"), F.lit(MAP_BITS))
    words = wanted.select(F.shiftright(bit, 5).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(tkey, {MAP_BITS}) & 31 as int))").alias("bit"))
    filled = np.zeros(MAP_BITS // 32, np.int64)
    held_words = local(words.groupBy("word").agg(F.bit_or("bit").alias("bits")))
    filled[held_words["word"]] = held_words["bits"]
    filled = filled.astype(np.uint32)

    @F.pandas_udf("boolean")
    def held(tkey: pd.Series) -> pd.Series:
        at = tkey.to_numpy() % MAP_BITS
        return pd.Series((filled[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1)

    found = docs.select(text_key(text_col).alias("tkey"), F.col(text_col).alias("text")).where(held("tkey"))
    return found.groupBy("tkey").agg(F.first("text").alias("text")).select("text")


def whole_sets(docs: DataFrame, text_col: str, shingle: int, wanted: DataFrame) -> DataFrame:
    """(digest, hashes) of the shingle sets of wanted_texts."""

    @F.pandas_udf("struct<digest:long,hashes:array<long>>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in sliced(batches):
            sets = [shingle_set(t, shingle) for t in texts]
            yield pd.DataFrame({"digest": signed64(np.array([set_digest(s) for s in sets], np.uint64)), "hashes": [signed64(s) for s in sets]})

    found = wanted_texts(docs, text_col, wanted)
    return found.select(of("text").alias("s")).select("s.*").dropDuplicates(["digest"])


def similar_links(docs: DataFrame, text_col: str, shingle: int, texts: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (x, y: digests) whose whole shingle sets have that Jaccard similarity, as src and dst."""
    ends = pairs.select(F.col("x").alias("digest")).distinct().unionByName(pairs.select(F.col("y").alias("digest")).distinct()).distinct()
    sets = settled(whole_sets(docs, text_col, shingle, texts.join(ends, "digest", "left_semi").select("tkey")), "sets")
    sets_of = lambda c, s: sets.select(F.col("digest").alias(c), F.col("hashes").alias(s))
    told = pairs.join(unsent(sets_of("x", "s")), "x").join(unsent(sets_of("y", "t")), "y")
    shared = F.size(F.array_intersect("s", "t"))
    links = settled(told.where(shared >= similarity * (F.size("s") + F.size("t") - shared) - 1e-9).select(F.col("x").alias("src"), F.col("y").alias("dst")), "links")
    release(sets)
    return links


def shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many values the sets numbered left share with those numbered right: products of 0-1 matrices, some columns at a time."""
    sizes = np.array([len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times[column] > 1
    owner, column = np.repeat(np.arange(len(sets)), sizes)[common], (np.cumsum(times > 1) - 1)[column[common]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    n, step = int((times > 1).sum()), max(1, MATRIX // len(sets))
    ends, counts = np.searchsorted(column, np.arange(0, n + step, step)), np.zeros((len(left), len(right)))
    for k, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        has = np.zeros((len(sets), min(step, n - k * step)), np.float32)
        has[owner[i:j], column[i:j] - k * step] = 1
        counts += has[left] @ has[right].T
    return counts


def cell_links(ids: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], side: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (src, dst), at most one per text, that connect what the similar pairs of a cell connect.

    The texts of side 0 are compared with those of side 1, or with each other if all are of one side, unless they
    have one root; similar means a Jaccard similarity of the whole sets from `similarity` on.
    """
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    within = not len(left) or not len(right)
    if within:
        left = right = np.arange(len(ids))
    sizes = np.array([len(s) for s in sets])
    shared = shared_counts(sets, left, right)
    near = shared >= similarity * (sizes[left][:, None] + sizes[right] - shared) - 1e-9
    near &= roots[left][:, None] != roots[right]
    i, j = np.nonzero(np.triu(near, 1) if within else near)
    i, j = left[i], right[j]
    least, before = np.arange(len(ids)), None
    while before is None or (least != before).any():
        before = least.copy()
        np.minimum.at(least, j, least[i])
        np.minimum.at(least, i, least[j])
    moved = least != np.arange(len(ids))
    return ids[moved], ids[least[moved]]


def runs(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of each value of `by` in one frame, of rows sorted by it."""
    held: list[pd.DataFrame] = []
    for rows in batches:
        if rows.empty:
            continue
        values = [rows[c].to_numpy() for c in by]
        starts = [0, *(np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1).tolist(), len(rows)]
        if held and any(held[-1][c].iloc[-1] != v[0] for c, v in zip(by, values, strict=True)):
            yield pd.concat(held)
            held = []
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            held.append(rows.iloc[a:b])
            if b < len(rows):
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
    if held:
        yield pd.concat(held)


def open_links(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (src, dst) that join the components (root) of members (key, x, root, home) whose sets are similar, key by key.

    Of each key, the members outside its component `home` are compared with each other and with those inside. Both are
    dealt out over blocks by a hash, and each pair of blocks is a cell of its own, of bounded size; a cell returns at
    most a row per text, never pairs. sets: (digest, hashes) of every x.
    """
    sized = members.join(unsent(sets.select(F.col("digest").alias("x"), F.size("hashes").alias("size"))), "x").withColumn("inside", F.col("root") == F.col("home"))
    blocks = lambda inside: F.ceil(F.greatest(F.count_if(inside) / BLOCK_TEXTS, F.sum(F.when(inside, F.col("size")).otherwise(0)) / BLOCK_SHINGLES)).cast("int")
    counted = sized.groupBy("key").agg(blocks(F.col("inside")).alias("ins"), blocks(~F.col("inside")).alias("outs"))
    own = F.pmod(F.xxhash64("x"), F.when(F.col("inside"), F.col("ins")).otherwise(F.col("outs"))).cast("int")
    cell = lambda a, b, across, side: F.struct(a.alias("a"), b.alias("b"), F.lit(across).alias("across"), side.alias("side"))
    outs, ins = F.sequence(F.lit(0), F.col("outs") - 1), F.sequence(F.lit(0), F.col("ins") - 1)
    met = F.transform(outs, lambda o: cell(o, own, True, F.lit(1)))
    meets = F.concat(
        F.transform(outs, lambda o: cell(F.least(own, o), F.greatest(own, o), False, (own > o).cast("int"))),
        F.transform(ins, lambda i: cell(own, i, True, F.lit(0))),
    )
    by = ["key", "a", "b", "across"]
    cells = sized.join(unsent(counted), "key").select("key", "x", "root", F.explode(F.when(F.col("inside"), met).otherwise(meets)).alias("cell")).select("x", "root", "key", "cell.*")
    dealt = cells.join(unsent(sets.select(F.col("digest").alias("x"), "hashes")), "x").repartition(*by).sortWithinPartitions(*by)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in runs(batches, by):
            if len(rows) > 1:
                src, dst = cell_links(rows["x"].to_numpy(), rows["root"].to_numpy(), rows["hashes"].tolist(), rows["side"].to_numpy(), similarity)
                if len(src):
                    yield pd.DataFrame({"src": src, "dst": dst})

    return dealt.mapInPandas(compare, "src long, dst long")


def fingerprint_pairs(texts: DataFrame, threshold: int, hot: int) -> DataFrame:
    """Pairs (x, y: digests) that the fingerprints tell of: equal ones with one of them, and those within threshold bits."""
    held = settled(texts.groupBy("fp").agg(F.min("digest").alias("y")), "held")
    same = texts.join(held, "fp").select(F.col("digest").alias("x"), "y")
    near = fingerprint_links(held.select("fp"), threshold, hot)
    near = near.join(held.select(F.col("fp").alias("src"), F.col("y").alias("x")), "src").join(held.select(F.col("fp").alias("dst"), "y"), "dst").select("x", "y")
    return same.unionByName(near)


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, threshold: int = 4, hot: int = 256, bands: int = 24, band_rows: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, component_id, over the links of texts whose shingle sets have that similarity.

    Candidates are the pairs that the fingerprints tell of (simhash_components' probe, within `threshold` bits) and,
    since 64 bits can't tell a similarity of 0.8, those that share a band of smallest hashes: a pair at the similarity
    misses all bands with a chance of (1 - similarity ** band_rows) ** bands, 7e-5 by default, whatever the edits are
    and however long the texts. Each candidate is verified by the whole shingle sets. Equal sets are one text.

    A band's texts are first compared with one of them, drawn by hash, and of those each text with the one that it
    meets most often; then with the others that are still in other components; so a large group of copies becomes one
    component in proportion to its rows. Then every other pair of a band that isn't yet in one component is compared by
    whole sets too, in cells of two blocks of bounded size that return no pairs. That part's arithmetic still grows with
    the square of a group whose texts are alike, but not alike enough to join one component.
    Null and empty texts are alike. A null id gets the component's smallest id, null if it has none.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("tkey"), text_columns(F.col(text_col), shingle, bands, band_rows).alias("p"))
    rows = settled(rows.select("doc_id", "tkey", "p.*"), "near")
    texts = rows.groupBy("digest").agg(F.min("doc_id").alias("low"), F.min("tkey").alias("tkey"), F.min("fp").alias("fp"), F.first("keys").alias("keys"))
    texts = settled(texts, "texts")
    stand = texts.select(F.col("digest").alias("x"), F.explode("keys").alias("key"))
    drawn = stand.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "x").alias("h"), "x")).alias("one"), F.count("*").alias("times")).where("times > 1")
    stand = settled(stand.join(unsent(drawn.select("key", F.col("one.x").alias("y"))), "key"), "stand")
    pairs = stand.select("x", "y").unionByName(fingerprint_pairs(texts, threshold, hot)).where("x != y")
    pairs = settled(pairs.groupBy(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).agg(F.count("*").alias("votes")), "pairs")
    best = pairs.groupBy("x").agg(F.max_by("y", F.struct("votes", "y")).alias("y"))
    links = similar_links(docs, text_col, shingle, texts, settled(best, "best"), similarity)
    labels = settled(near_labels(links), "labels")
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"root_{c}"))
    apart = F.coalesce("root_x", "x") != F.coalesce("root_y", "y")
    others = settled(pairs.join(unsent(best), ["x", "y"], "left_anti").join(unsent(of("x")), "x", "left").join(unsent(of("y")), "y", "left").where(apart).select("x", "y"), "others")
    if not others.isEmpty():
        links = links.unionByName(similar_links(docs, text_col, shingle, texts, others, similarity))
    roots = connected_components(links)
    stand = stand.select("key", "x").join(unsent(roots.select(F.col("node").alias("x"), "root")), "x", "left").withColumn("root", F.coalesce("root", "x"))
    stand = settled(stand, "rooted")
    sizes = stand.groupBy("key", "root").count()
    homes = sizes.groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("home"), F.count("*").alias("roots")).where("roots > 1").select("key", "home")
    open_ = settled(stand.join(unsent(homes), "key"), "open")
    if not open_.isEmpty():
        ends = texts.join(unsent(open_.select(F.col("x").alias("digest")).distinct()), "digest", "left_semi")
        sets = settled(whole_sets(docs, text_col, shingle, ends.select("tkey")), "sets")
        rest = settled(open_links(open_, sets, similarity).distinct(), "rest")
        release(sets)
        if not rest.isEmpty():
            roots = connected_components(links.unionByName(rest))
    classes = texts.join(roots, F.col("digest") == F.col("node"), "left").select("digest", "low", F.coalesce("root", "digest").alias("root"))
    least = classes.groupBy(F.col("root").alias("_root")).agg(F.min("low").alias("component_id"))
    told = settled(classes.join(least, F.col("root") == F.col("_root")).select(F.col("digest").alias("digest2"), "component_id"), "classes")
    return rows.join(told, F.col("digest") == F.col("digest2")).select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one row of each component of near_duplicate_components: that of the smallest id; of repeated ids, one row.

    Rows without an id stay only if their component has no id at all, and then one of each distinct text. All columns
    of docs stay, whatever their names.
    """
    keep_col, nth = unused(docs, "keep"), unused(docs, "nth")
    parts = near_duplicate_components(docs, id_col, text_col, **how)
    keep = parts.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(keep_col)).distinct()
    keep = settled(keep, "keep")
    named = docs.where(F.col(id_col).isNotNull()).join(keep, F.col(id_col) == F.col(keep_col), "left_semi")
    key = text_key(text_col)  # rows lie by id already: no second shuffle
    kept = named.withColumn(nth, F.row_number().over(Window.partitionBy(id_col).orderBy(key))).where(F.col(nth) == 1).drop(nth)
    if keep.where(F.col(keep_col).isNull()).isEmpty():
        return kept
    nameless = docs.where(F.col(id_col).isNull()).withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(key)))
    return kept.unionByName(nameless.where(F.col(nth) == 1).drop(nth))
