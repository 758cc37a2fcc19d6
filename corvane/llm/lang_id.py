"""Language of a text: the nearest of several centroids per language, over TF-IDF of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import local, share_below, unused

#: Hashed n-gram features, and the n-gram lengths.
FEATURES, ORDERS = 4096, (1, 2, 3)
#: Labelled rows that the classifier is fitted on, about: per language, and in all; of each language at least so many.
FIT_PER_LANG, FIT_ROWS, FIT_LEAST = 800, 4000, 8
#: Labels beyond this number are no languages: an error, since each has centroids in the broadcast model.
MOST_LANGS = 4000
CENTROIDS = 4
#: A text is rejected if its best cosine is below this share of a low quantile of the labelled texts of its length.
REJECT_SHARE, REJECT_QUANTILE = 0.6, 0.005
_BLOCK = 1 << 18
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _letters


def gram_counts(text: str) -> tuple[np.ndarray, int]:
    """Counts of the hashed n-grams of a whole text, and its number of letters. Runs of other characters are one space."""
    counts, n_letters, tail = np.zeros(FEATURES), 0, np.full(1, 32, np.uint32)
    for start in range(0, len(text), _BLOCK):  # a very long text in blocks, overlapping by the longest n-gram less one
        code = np.frombuffer(text[start : start + _BLOCK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letters()[code]
        n_letters += int(is_letter.sum())
        code = np.concatenate((tail, np.where(is_letter, code, np.uint32(32))))
        keep = np.ones(len(code), bool)
        keep[1:] = (code[1:] != 32) | (code[:-1] != 32)
        code = code[keep]
        if start + _BLOCK >= len(text) and code[-1] != 32:
            code = np.append(code, np.uint32(32))
        old = len(tail) if start else 0
        for n in ORDERS:
            if len(code) >= n:
                h = np.full(len(code) - n + 1, n, np.uint32)
                for j in range(n):
                    h = (h ^ code[j : len(code) - n + 1 + j]) * np.uint32(0x9E3779B1)
                    h ^= h >> np.uint32(15)
                counts += np.bincount(h[max(0, old - n + 1) :] % FEATURES, minlength=FEATURES)
        tail = code[-(max(ORDERS) - 1) :]
    return counts, n_letters


def length_bin(n_letters: int) -> int:
    return min(12, int(n_letters).bit_length())


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # rows of unit length
    lang_of: np.ndarray  # of each centroid
    least: np.ndarray  # least cosine that is accepted, by length bin

    def vector(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf
        return v / (np.sqrt(v @ v) or 1.0)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine with its nearest centroid, whether that is too far); und without any letter."""
        counts, n = gram_counts(text) if text else (None, 0)
        if not n or not self.langs:
            return "und", 0.0, True
        near = self.centroids @ self.vector(counts)
        best = int(near.argmax())
        score = float(min(1.0, max(0.0, near[best])))
        return self.langs[self.lang_of[best]], score, score < self.least[length_bin(n)]


def spherical_k_means(x: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        centres = np.array([x[own == c].mean(0) for c in np.unique(own)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1), 1e-12)[:, None]
    return centres


def sparse_grams(texts: pd.Series) -> pd.DataFrame:
    out = []
    for t in texts:
        counts, n = gram_counts(t or "")
        at = np.flatnonzero(counts)
        out.append((n, at.astype(np.int32), counts[at].astype(np.float32)))
    return pd.DataFrame(out, columns=["n", "at", "of"])


def quotas(sizes: dict[str, int]) -> dict[str, int]:
    """The hash up to which each language's rows are taken, of its number of rows."""
    share = min(FIT_PER_LANG, max(FIT_LEAST, FIT_ROWS // len(sizes)))
    return {lang: share_below(share / n) for lang, n in sizes.items()}


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", seed: int = 5) -> Model:
    """A model of labelled rows; null texts and languages are left out.

    The fit takes a sample chosen by a hash of id and text: about FIT_PER_LANG rows of each language, FIT_ROWS in all,
    FIT_LEAST of each at least (all rows of a language with fewer). Whole texts are turned into n-grams on the
    executors; the driver gets the sample's sparse counts.
    """
    grams = F.pandas_udf(sparse_grams, "struct<n:int,at:array<int>,of:array<float>>")
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h"))
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().orderBy("lang").limit(MOST_LANGS + 1).collect()}
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"{lang_col} has more than {MOST_LANGS} values")
    if not sizes:
        return Model([], np.ones(FEATURES), np.zeros((0, FEATURES)), np.zeros(0, int), np.zeros(13))
    quota = F.create_map(*[F.lit(x) for lang, below in quotas(sizes).items() for x in (lang, below)])
    sample = local(rows.where(F.col("h") <= F.element_at(quota, F.col("lang"))).select("lang", "h", grams("text").alias("g")).select("lang", "h", "g.*"))
    sample = sample.sort_values(["lang", "h"], kind="stable", ignore_index=True)
    counts = np.zeros((len(sample), FEATURES), np.float32)
    for i, (at, of) in enumerate(zip(sample.pop("at"), sample.pop("of"), strict=True)):
        counts[i, at] = of
    idf = (np.log((1 + len(sample)) / (1 + np.count_nonzero(counts, 0))) + 1).astype(np.float32)
    v = np.log1p(counts, out=counts)
    v *= idf
    v /= np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), np.float32(1e-12))[:, None]
    langs = sorted(set(sample["lang"]))
    own = sample["lang"].map(langs.index).to_numpy() if langs else np.zeros(0, int)
    parts = [spherical_k_means(v[own == i], CENTROIDS, seed) for i in range(len(langs))]
    centroids = np.concatenate(parts) if parts else np.zeros((0, FEATURES))
    lang_of = np.repeat(np.arange(len(langs)), [len(p) for p in parts])
    near, bins = (v @ centroids.T).max(1) if len(v) else np.zeros(0), np.array([length_bin(n) for n in sample["n"]], int)
    least, floor = np.zeros(13), 0.0
    for b in range(13):  # longer texts are nearer; a length without enough rows takes the shorter one's bound
        if (bins == b).sum() >= 20:
            floor = max(floor, REJECT_SHARE * float(np.quantile(near[bins == b], REJECT_QUANTILE)))
        least[b] = floor
    return Model(langs, idf, centroids, lang_of, least)


def predict(model: Model, text: Column, df: DataFrame) -> Column:
    """Struct of lang_pred, score and rejected."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([sent.value.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    return of(text)


def identify_language(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with lang_pred, score (cosine with the nearest centroid, 0 to 1) and rejected (too far from every centroid).

    Learned from the rows that meet `train`; lang_pred is a learned language, also where rejected, and und for null
    texts, texts without a letter, or if nothing could be learned. Columns of docs stay, those named like a result are
    replaced. The model (CENTROIDS centroids a language, of FEATURES values) is broadcast; nothing is shuffled
    but the sample. Repeated rows get equal results.
    """
    model = fit(docs.where(train), text_col, lang_col, id_col)
    told = unused(docs, "lang_id")
    out = docs.withColumn(told, predict(model, F.col(text_col), docs))
    return out.withColumns({c: F.col(f"{told}.{c}") for c in ("lang_pred", "score", "rejected")}).drop(told)
