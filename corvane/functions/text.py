"""Texts and tags as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Lower-case words (runs of letters a-z, digits and characters beyond ASCII), in order, repeats included."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def content_words(text: Column, stop: list[str]) -> Column:
    """Distinct words without the stop words."""
    return F.array_distinct(F.array_except(words(text), F.array(*[F.lit(w) for w in stop]).cast("array<string>")))


def sentence_words(text: Column, stop: list[str] = ()) -> Column:
    """Content word sets of the sentences, empty ones left out."""
    return F.filter(F.transform(F.split(text, r"[.!?\n]+"), lambda s: content_words(s, stop)), lambda w: F.size(w) > 0)


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def containment(part: Column, whole: Column) -> Column:
    """Share of the distinct words of part that whole has, 0 if either is empty."""
    return F.when((F.size(part) == 0) | (F.size(whole) == 0), 0.0).otherwise(F.size(F.array_intersect(part, whole)) / F.size(F.array_distinct(part)))


def any_phrase(text: Column, phrases: list[str]) -> Column:
    """Whether the text, with case and white space evened out, has one of the phrases. An empty text has not."""
    even = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))
    out = F.lit(False)
    for p in phrases:
        out = out | even.contains(p)
    return out


def split_tags(tags: Column, sep: str = ",", blanks: tuple[str, ...] = ()) -> Column:
    """Trimmed tags in order, without blanks, placeholders and repeats."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(tags, F.lit("")), sep), lambda t: F.trim(t)), lambda t: (t != "") & ~t.isin("", *blanks)))


def snippet(text: Column, n: int = 200) -> Column:
    return F.left(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(n))


def plain_title(title: Column) -> Column:
    """Lower case, without a trailing part in brackets and a trailing "- part"."""
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(title, r"\s*\([^)]*\)\s*$", ""), r"\s+-\s+[^-]+$", "")))



def first_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"-?[0-9]+(\.[0-9]+)?", 0), F.lit("")).try_cast("double")


def token_estimate(text: Column, chars_per_token: float) -> Column:
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / F.lit(chars_per_token)).cast("long")


def pair_totals(question: Column, texts: Column, chars_per_token: float, limit: int) -> dict[str, Column]:
    """Of a question and the texts to rank for it: tokens by estimate in all and at most, the largest pair of question and
    text, how many pairs are over the limit, and bytes. No texts: zeros."""
    asked, sizes = token_estimate(question, chars_per_token), F.transform(texts, lambda t: token_estimate(t, chars_per_token))
    none = F.lit(0).cast("long")
    return {
        "tokens": F.aggregate(sizes, none, lambda a, x: a + x), "longest": F.coalesce(F.array_max(sizes), none), "pair_longest": F.coalesce(F.array_max(sizes) + asked, none),
        "over": F.size(F.filter(sizes, lambda x: x + asked > limit)).cast("long"), "bytes": F.aggregate(texts, none, lambda a, t: a + F.coalesce(F.octet_length(t), F.lit(0))),
    }


def rank_input(texts: Column, most: int = 32_000) -> Column:
    """Copies of the texts to hand to a reranker, cut to `most` characters; a null text is empty."""
    return F.transform(texts, lambda t: F.left(F.coalesce(t, F.lit("")), F.lit(most)))


def key_hash(*parts: Column, n: int = 16) -> Column:
    """First n hex digits of the SHA-256 of the parts joined by the unit separator."""
    return F.left(F.sha2(F.concat_ws("\x1f", *parts), 256), F.lit(n))


def hash_share(text: Column) -> Column:
    """A number in [0, 1] from the first eight hex digits of the SHA-256."""
    return F.conv(F.left(F.sha2(text, 256), F.lit(8)), 16, 10).cast("double") / F.lit(4294967295.0)


def cited_places(answer: Column, ids: Column) -> Column:
    """Ids that an answer names, literally or as [n] with n their place."""
    numbers = F.transform(F.regexp_extract_all(answer, F.lit(r"\[([0-9]+)\]"), F.lit(1)), lambda n: F.get(ids, n.try_cast("int") - 1))
    return F.array_union(F.filter(ids, lambda i: answer.contains(i)), F.filter(numbers, lambda x: x.isNotNull()))
