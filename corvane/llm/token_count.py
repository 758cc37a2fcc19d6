"""Token counts by byte-pair merging on a heap and a linked list."""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space as Unicode's White_Space property has it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Distinct words whose counts one Python worker keeps.
KEPT_WORDS = 300_000


class Vocabulary:
    """What a word-end BPE file says: ranks of its pairs, how it splits text into words, its special strings.

    Read on the driver and sent to the executors: some 50,000 merges, whatever the corpus holds.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = split["pattern"]["Regex"].replace("\\s", SPACE)
        self.special = [t["content"] for t in spec["added_tokens"] if not t["normalized"]]
        self.lower = any(n["type"] == "Lowercase" for n in spec["normalizer"]["normalizers"])


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if visible, else the next free one from 256 on."""
    out, free = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


def count_merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after merging, pair of lowest rank first and leftmost among equals, until no pair has a rank."""
    n = len(symbols)
    if n < 2:
        return n
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        rank, i = heapq.heappop(heap)
        if symbols[i] is None or (j := right[i]) >= n or ranks.get((symbols[i], symbols[j])) != rank:
            continue  # one of the two has been merged meanwhile
        symbols[i] += symbols[j]
        symbols[j] = None
        merges += 1
        right[i] = k = right[j]
        if k < n:
            left[k] = i
            if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i))
        if (h := left[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h))
    return n - merges


class WordCounts(dict):
    """word -> tokens. A miss merges the word; the table starts anew when full, so memory stays bounded."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.ranks, self.suffix, self.letters = vocabulary.ranks, vocabulary.suffix, byte_letters()

    def __missing__(self, word: str) -> int:
        symbols = [self.letters[b] for b in word.encode("utf-8")]
        symbols[-1] += self.suffix
        n = count_merged(symbols, self.ranks)
        if len(word) <= 64:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = n
        return n


class Counter:
    def __init__(self, vocabulary: Vocabulary):
        self.words = WordCounts(vocabulary)
        self.find = regex.compile(vocabulary.pattern).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None
        self.markers = vocabulary.special
        self.lower = vocabulary.lower

    def piece(self, text: str) -> int:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            text = text.lower() if "Σ" not in text else text.replace("Σ", "σ").lower()  # no final-sigma rule
        return sum(map(self.words.__getitem__, self.find(text)))

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if any(m in text for m in self.markers):
            found = self.special.findall(text)
            return len(found) + sum(map(self.piece, self.special.split(text)))
        return self.piece(text)


_counters: dict[str, Counter] = {}


def _counter(key: str, vocabulary: Vocabulary) -> Counter:
    """One per worker and vocabulary, so that tasks of a worker share the words it has merged."""
    if key not in _counters:
        _counters[key] = Counter(vocabulary)
    return _counters[key]


def count_tokens(docs: DataFrame, vocabulary_path: str, text_col: str = "text", limit: int = 2048) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit), and nothing shuffled.

    Null and empty texts have 0 bytes and 0 tokens. Columns of docs stay, those named like a result are replaced.
    A very long run of characters that the vocabulary takes for one word costs n log n. Repeated rows count alike.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary_path))
    key = vocabulary_path

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = _counter(key, vocabulary.value)
        for texts in batches:
            yield pd.Series([count(t) for t in texts], dtype="int64")

    text = F.col(text_col)
    out = docs.withColumns({"n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "n_tokens": tokens(text)})
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
