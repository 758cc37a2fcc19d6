"""Repeated passages: blocks of every document as anchors, probed by every rolling window, extended to whole repeats."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, settled

#: Bits of a window's hash below those that name its cell; an entry is these and two marks, in five bytes.
REST = 38
#: Words (by an estimate of six bytes each) that a cell of the index holds; rows of a group that are probed together.
CELL_WORDS, GROUP_ROWS, LEAST_CELLS = 1 << 20, 512, 64
STEP = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Two independent 64-bit hashes of each word, as rows of an array."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), dtype=">u8").astype(np.uint64).reshape(-1, 2)


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k of a text's words, from the words' hashes; fewer words: none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = out * STEP + hashes[i:i + n]
    return out


def packed(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(blob, dtype=np.uint8).reshape(-1, 5)
    return out.view("<u8").reshape(-1).astype(np.uint64)


def edges(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]][:len(values)])


def split_words(text: pa.Scalar) -> list[bytes]:
    """Runs of anything but ASCII white space."""
    return text.as_py().encode().split()


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, group, doc, text, written: every row gets a number, and rows that lie together a group of at most GROUP_ROWS.

    Null ids become the largest number there is; null texts are empty.
    """
    row = F.monotonically_increasing_id()
    rows = docs.select(row.alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return settled(rows.select("row", F.floor(F.col("row") / GROUP_ROWS).alias("group"), "doc", "text"), "numbered")


def anchored(texts: DataFrame, window: int, cell_bits: int) -> DataFrame:
    """group, cell, hits: the hashes of a group's blocks that lie on an anchor and occur more than once in all.

    A window of `window` words holds a whole reference block: the non-overlapping runs of half as many words of every
    text. So if a window repeats, one of the rolling runs inside it meets the reference block inside the other. Every
    rolling run of a text is probed: a group's runs are listed once each, with marks for "starts a block" and "more than
    one here", and sent to the cell that the hash's first bits name. Marks that two groups bring to one cell make a hit.
    A cell's entries are at most one a group and run, so a passage of all texts is an entry a group, not one a text.
    """
    block = (window + 1) // 2

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            groups = b.column("group").to_numpy()
            cuts = edges(groups)
            for at, end in zip(cuts, [*cuts[1:], len(groups)]):
                found, starts = [], []
                for text in b.column("text").slice(at, end - at):
                    runs = rolling(word_hashes(split_words(text))[:, 0], block)
                    found.append(runs)
                    starts.append(np.arange(len(runs)) % block == 0)
                runs = np.concatenate(found) >> np.uint64(64 - cell_bits - REST)
                if not len(runs):
                    continue
                order = np.argsort(runs, kind="stable")
                runs, anchor = runs[order], np.concatenate(starts)[order]
                first = edges(runs)
                n = np.diff(np.r_[first, len(runs)])
                marks = (np.bitwise_or.reduceat(anchor, first) * 2 + (n > 1)).astype(np.uint64)
                runs = runs[first]
                cells = (runs >> np.uint64(REST)).astype(np.int64)
                values = (runs & np.uint64((1 << REST) - 1)) << np.uint64(2) | marks
                edge = edges(cells)
                blobs = [packed(values[i:j]) for i, j in zip(edge, [*edge[1:], len(cells)])]
                yield pa.RecordBatch.from_arrays([pa.array(cells[edge]), pa.array(np.full(len(edge), groups[at])), pa.array(blobs, pa.binary())], ["cell", "group", "entries"])

    def met(cell: pa.Table) -> pa.Table:
        lists = [unpacked(x.as_py()) for x in cell.column("entries")]
        values, owner = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        order = np.argsort(values >> np.uint64(2), kind="stable")
        values, owner = values[order], owner[order]
        rest, marks = values >> np.uint64(2), values & np.uint64(3)
        first = edges(rest)
        n = np.diff(np.r_[first, len(rest)])
        all_marks = np.bitwise_or.reduceat(marks, first)
        loud = np.repeat((all_marks >= 2) & ((n > 1) | (all_marks % 2 == 1)), n)
        rest, owner = rest[loud], owner[loud]
        order = np.argsort(owner, kind="stable")
        rest, owner = rest[order], owner[order]
        edge = edges(owner)
        blobs = [packed(rest[i:j]) for i, j in zip(edge, [*edge[1:], len(owner)])]
        groups = cell.column("group").combine_chunks().take(pa.array(owner[edge]))
        number = cell.column("cell")[0].as_py()
        return pa.table([groups, pa.array(np.full(len(edge), number)), pa.array(blobs, pa.binary())], names=["group", "cell", "hits"])

    listed = texts.select("group", "text").mapInArrow(entries, "cell long, group long, entries binary")
    return listed.groupBy("cell").applyInArrow(met, "group long, cell long, hits binary")


def candidates(texts: DataFrame, hits: DataFrame, window: int, cell_bits: int) -> DataFrame:
    """row, doc, at, k1, k2: the windows around hits that are the first of their words in their group (doc, then start),
    with 128 bits of hash; and, with null hashes, the later ones in that group, which need no more asking."""
    block = (window + 1) // 2
    schema = "row long, doc long, at int, k1 long, k2 long"

    def around(group: pa.Table, hit: pa.Table) -> pa.Table:
        if not group.num_rows or not hit.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())], names=["row", "doc", "at", "k1", "k2"])
        loud = np.sort(np.concatenate([np.uint64(c.as_py() << REST) | unpacked(h.as_py()) for c, h in zip(hit.column("cell"), hit.column("hits"))]))
        parts = []
        for row, doc, text in zip(group.column("row").to_numpy(), group.column("doc").to_numpy(), group.column("text")):
            hashes = word_hashes(split_words(text))
            if len(hashes) < window:
                continue
            runs = [rolling(hashes[:, i], block) for i in (0, 1)]
            key = runs[0] >> np.uint64(64 - cell_bits - REST)
            place = np.minimum(np.searchsorted(loud, key), len(loud) - 1)
            before = np.r_[0, np.cumsum(loud[place] == key)]
            n = len(hashes) - window + 1
            at = np.flatnonzero(before[window - block + 1:window - block + 1 + n] > before[:n])
            if len(at):
                rest = window - block  # a window is a block and what follows it
                scale = np.uint64(pow(int(STEP), rest, 1 << 64))
                tails = [r[at + block] for r in runs] if rest == block else [rolling(hashes[block:, i], rest)[at] for i in (0, 1)]
                parts.append((np.full(len(at), row), np.full(len(at), doc), at.astype(np.int32), *(runs[i][at] * scale + tails[i] for i in (0, 1))))
        if not parts:
            return around(group.slice(0, 0), hit)
        row, doc, at, k1, k2 = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((at, doc, k2, k1))
        new = np.r_[True, (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])]
        head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        later = np.zeros(len(order), dtype=bool)  # in the rows' own order, which is what packs well
        later[order] = (doc[order] != doc[head]) | (at[order] != at[head])
        keys = [pa.array(k.view(np.int64), mask=later) for k in (k1, k2)]
        return pa.table([pa.array(row), pa.array(doc), pa.array(at), *keys], names=["row", "doc", "at", "k1", "k2"])

    return texts.groupBy("group").cogroup(hits.groupBy("group")).applyInArrow(around, schema)


def repeats(texts: DataFrame, window: int = 20) -> DataFrame:
    """row, starts: for each numbered row with windows that also start earlier, where those windows start. Together they
    cover the row's maximal repeats."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cell_bits = max(LEAST_CELLS.bit_length() - 1, int(size // 6 // CELL_WORDS).bit_length())
    hits = settled(anchored(texts, window, cell_bits), "hits")
    asked = settled(candidates(texts, hits, window, cell_bits), "windows")
    release(hits)
    earliest = F.rank().over(Window.partitionBy("k1", "k2").orderBy("doc", "at"))
    later = asked.where("k1 IS NOT NULL").select("row", "at", earliest.alias("_place")).where("_place > 1").select("row", "at")
    later = later.unionByName(asked.where("k1 IS NULL").select("row", "at"))
    starts = later.groupBy("row").agg(F.sort_array(F.collect_list("at")).alias("starts"))
    out = settled(starts, "repeats")
    release(asked)
    return out


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, texts_too: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 and, if texts_too, kept (the words left, joined by one space).

    Words are runs of anything but ASCII white space, unchanged. A window is `window` consecutive words of one
    document; every word covered by a window whose words also start earlier (smaller doc_id, or the same document, earlier
    start) goes. Windows are judged on the input. Null and empty texts have no words; texts shorter than a window keep
    all; a null id is the last of all; rows of one id are versions of one document, none of which is earlier than the
    other; no rows give no rows. Other columns of docs are left out.

    A hit of an anchor only says where to look: windows are told apart by 128 bits of hash, in the group of rows first
    and then over all, so no pair of documents is ever formed, and words that a thousand windows share cost a row a group.
    """
    texts = numbered(docs, id_col, text_col)
    found = repeats(texts, window)
    joined = texts.join(found.select(F.col("row").alias("_row"), "starts"), F.col("row") == F.col("_row"), "left")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, words, gone, sums, left = [], [], [], [], []
            for ident, text, starts in zip(b.column("doc").to_pylist(), b.column("text"), b.column("starts")):
                own = split_words(text)
                words.append(len(own))
                if starts.is_valid:
                    cover = np.zeros(len(own) + 1, dtype=np.int64)
                    at = starts.values.to_numpy()
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + window, -1)
                    stays = np.cumsum(cover)[:-1] == 0
                    own = [w for w, s in zip(own, stays.tolist()) if s]
                rest = b" ".join(own)
                doc.append(None if ident == 2**63 - 1 else ident)
                gone.append(words[-1] - len(own))
                sums.append(hashlib.sha256(rest).hexdigest())
                left.append(rest.decode() if texts_too else None)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(words, pa.int64()), pa.array(gone, pa.int64()), pa.array(sums, pa.string()), pa.array(left, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return joined.select("doc", "text", "starts").mapInArrow(kept, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string").drop(*[] if texts_too else ["kept"])


def oracle(window: int = 20) -> str:
    """The same over documents, for unique ids, as DuckDB SQL: every window spelled out and ranked."""
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {window - 2}, 1))) AS place FROM d),
r AS (SELECT doc_id, place, row_number() OVER (PARTITION BY array_to_string(w[place:place + {window - 1}], ' ') ORDER BY doc_id, place) AS p FROM s),
gone AS (SELECT DISTINCT doc_id, unnest(range(place, place + {window})) AS i FROM r WHERE p > 1),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM u ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)"""
