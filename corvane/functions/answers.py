"""Scores of answers against what was retrieved and asked, as column expressions. Null: a score that does not apply."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scores import clip, sigmoid, weighted_mean
from .text import any_phrase, cited_places, content_words, sentence_words, words


def composite(parts: dict[str, Column], weights: dict[str, float], aliases: dict[str, str] | None = None, others: float = 0.0) -> Column:
    """Weighted mean of the parts that are not null, null if all are.

    A part goes by its alias's weight; those without a weight share `others` evenly, whether they are null or not.
    """
    named = {m: (aliases or {}).get(m, m) for m in parts}
    rest = sorted(m for m, name in named.items() if name not in weights)
    return weighted_mean([(c, weights[named[m]] if named[m] in weights else others / len(rest)) for m, c in parts.items()])


def composite_or_zero(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of the parts that are not null, 0 if all are."""
    return F.coalesce(weighted_mean(parts), F.lit(0.0))


def closeness(abstained: Column, semantic: Column, judge: Column, weight: float = 0.35) -> Column:
    """1 or 0 where an abstention decides; else the semantic score, blended with the judge's where there is one."""
    s = clip(semantic)
    return F.when(abstained.isNotNull(), abstained.cast("double")).when(judge.isNull(), s).otherwise(weight * s + (1 - weight) * clip(judge))


def squash(x: Column, kind: str) -> Column:
    """A raw score as a share: logit and margin by the sigmoid, unit clipped."""
    if kind in ("logit", "margin"):
        return sigmoid(x)
    if kind == "unit":
        return clip(x)
    raise ValueError(f"unknown kind of score: {kind}")


def rating_share(text: Column, default: float | None = 0.5) -> Column:
    """A rating of 1 to 5 as a share; default where it is no number (None: null)."""
    share = clip((text.try_cast("double") - 1) / 4)
    return share if default is None else F.coalesce(share, F.lit(default))


def merged_total(total: Column, retrieval: Column, stages: list[Column]) -> Column:
    """The total time, else that of retrieval, else the sum of the stages."""
    return F.coalesce(total, retrieval, sum((F.coalesce(s, F.lit(0.0)) for s in stages), F.lit(0.0)))


def ideal_text(wants: Column, gold: Column) -> Column:
    """What is wanted and each gold body (markdown, else snippet, else title), blank ones left out, by blank lines."""
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    bodies = F.transform(gold, lambda g: F.coalesce(full(g["markdown"]), full(g["snippet"]), full(g["title"])))
    return F.array_join(F.filter(F.concat(F.array(full(wants)), bodies), lambda b: b.isNotNull()), "\n\n")


def used_fragments(answer: Column, ids: Column, texts: Column, stop: list[str] = (), least: int = 2, share: float = 0.5) -> Column:
    """Ids that the answer cites; without any, those of which some sentence has `least` content words and `share` of its own."""
    cited = cited_places(answer, ids)
    sentences = sentence_words(answer, stop)
    pairs = F.arrays_zip(ids.alias("id"), F.transform(texts, lambda t: content_words(t, stop)).alias("w"))

    def hit(p: Column) -> Column:
        shared = lambda s: F.size(F.array_intersect(s, p["w"]))
        return F.exists(sentences, lambda s: (shared(s) >= least) & (shared(s) >= share * F.size(s)))

    return F.when(F.size(cited) > 0, cited).otherwise(F.transform(F.filter(pairs, hit), lambda p: p["id"]))


def grounding(used: Column, gold: Column, retrieved: Column) -> tuple[Column, Column]:
    """Precision (of what is used, the gold share) and recall (of the gold that was retrieved), 0 without any."""
    hits = F.size(F.array_intersect(used, gold)).cast("double")
    part = lambda n: F.coalesce(F.try_divide(hits, n.cast("double")), F.lit(0.0))
    return part(F.size(F.array_distinct(used))), part(F.size(F.array_intersect(gold, retrieved)))


def even(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def refuses(text: Column, phrases: list[str]) -> Column:
    """Whether an answer is empty or has one of the phrases."""
    return (even(text) == "") | any_phrase(text, phrases)


def substantive(text: Column, phrases: list[str], least: int = 4) -> Column:
    """Whether `least` words are left once the phrases are taken out."""
    left = even(text)
    for p in phrases:
        left = F.replace(left, F.lit(p), F.lit(" "))
    return F.size(F.filter(F.split(left, " "), lambda w: w != "")) >= least


def answerability(kind: Column, refused: Column, flagged: Column, answered: Column) -> tuple[Column, Column]:
    """(abstention_correct, unwarranted_refusal) for questions of kind none, partial or full; another kind raises.

    none: right if refused. partial: right if answered and the gap flagged. full: no abstention to judge, a refusal is bad.
    """
    wrong = F.raise_error(F.concat(F.lit("unknown kind: "), F.coalesce(kind, F.lit("null")))).cast("int")
    right = F.when(kind == "none", refused.cast("int")).when(kind == "partial", (answered & flagged).cast("int")).when(kind == "full", F.lit(None).cast("int")).otherwise(wrong)
    return right, F.when(kind == "full", refused.cast("int"))


def reference_kind(turn: Column, kind: Column) -> Column:
    """What a turn is held against: an abstention if nothing answers it, else gold in the first turn and wants later."""
    return F.when(kind == "none", "abstention").when(turn <= 1, "gold").otherwise("wants")


def coverage(reference: Column, texts: Column, stop: list[str]) -> tuple[Column, Column]:
    """Context precision and recall by content words, to four places; null without a reference, 0 without texts.

    A text is relevant if it shares a word with the reference; recall is the share of the reference's words that the
    texts have between them.
    """
    ref, held = content_words(reference, stop), _held(texts, stop)
    relevant = F.size(F.filter(texts, lambda t: F.arrays_overlap(content_words(t, stop), ref)))
    out = _share(relevant, F.size(texts)), _share(F.size(F.array_intersect(ref, held)), F.size(ref))
    return tuple(F.when(F.size(ref) > 0, x) for x in out)


def cross_checks(answer: Column, reference: Column, texts: Column, stop: list[str]) -> tuple[Column, Column]:
    """Faithfulness (share of the answer's content words that the texts have; 1 for an answer without any, which claims
    nothing) and factual correctness (share of the reference's words that the answer has; null without a reference)."""
    said, ref = content_words(answer, stop), content_words(reference, stop)
    faithful = F.when(F.size(said) == 0, 1.0).otherwise(_share(F.size(F.array_intersect(said, _held(texts, stop))), F.size(said)))
    return faithful, F.when(F.size(ref) > 0, _share(F.size(F.array_intersect(ref, said)), F.size(ref)))


def _held(texts: Column, stop: list[str]) -> Column:
    return F.array_distinct(F.flatten(F.transform(texts, lambda t: content_words(t, stop))))


def _share(a: Column, b: Column) -> Column:
    return F.bround(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 4)


def grounded_fraction(texts: Column, answer: Column, stop: list[str] = (), least: float = 0.4) -> Column:
    """Share of the texts that are not blank of which the answer has at least `least` of the content words; 0 without texts
    or without content words in the answer."""
    said = content_words(answer, stop)
    full = F.filter(texts, lambda t: F.trim(F.coalesce(t, F.lit(""))) != "")

    def held(t: Column) -> Column:
        own = content_words(t, stop)
        return (F.size(own) > 0) & (F.size(said) > 0) & (F.size(F.array_intersect(own, said)) >= least * F.size(own))

    return F.coalesce(F.try_divide(F.size(F.filter(full, held)).cast("double"), F.size(full).cast("double")), F.lit(0.0))


def bag_of_words(text: Column, slots: int = 32) -> Column:
    """Counts of the words by the first byte of their SHA-256 modulo slots."""
    at = F.transform(words(text), lambda w: F.pmod(F.conv(F.left(F.sha2(w, 256), F.lit(2)), 16, 10).cast("int"), F.lit(slots)))
    return F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda s: F.size(F.filter(at, lambda a: a == s)))


def gain(base: Column, new: Column) -> tuple[Column, Column]:
    """Absolute gain, and in per cent of the base: infinite for any base of 0 or less. A null has no gain."""
    up = new - base
    return up, F.when(base > 0, 100 * up / F.when(base > 0, base)).when(base <= 0, F.lit(float("inf")))


def log_safe(ms: Column, floor: float = 1.0) -> Column:
    return F.greatest(ms, F.lit(floor))


def variant_stem(name: Column, suffixes: list[str]) -> Column:
    """The name without one of the suffixes at its end."""
    return F.regexp_replace(name, "(" + "|".join(suffixes) + ")$", "")


def redact(text: Column, patterns: list[str], instead: str = "[author]") -> Column:
    for p in patterns:
        text = F.regexp_replace(text, p, instead)
    return text


def last_object(text: Column) -> Column:
    """The last flat {...} of a text, else what stands between its first { and last }; null without any."""
    flat = F.regexp_extract_all(text, F.lit(r"\{[^{}]*\}"), F.lit(0))
    outer = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    return F.coalesce(F.when(F.size(flat) > 0, F.element_at(flat, -1)), outer)


def persona(text: Column, fields: list[str]) -> list[Column]:
    """Fields of a text split at pipes, trimmed; "unknown" where blank or missing."""
    parts = F.split(F.coalesce(text, F.lit("")), r"\|")
    return [F.coalesce(F.nullif(F.trim(F.get(parts, F.lit(i))), F.lit("")), F.lit("unknown")).alias(f) for i, f in enumerate(fields)]


def scope_tags(country: Column, level: Column, default: str = "all") -> tuple[Column, Column]:
    """Tags of a list of comma strings, and of one comma string; blank ones left out, the default where none is left."""
    clean = lambda c: F.array_distinct(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != ""))
    many = clean(F.flatten(F.transform(F.coalesce(country, F.array().cast("array<string>")), lambda c: F.split(c, ","))))
    one = clean(F.split(F.coalesce(level, F.lit("")), ","))
    return tuple(F.when(F.size(c) > 0, c).otherwise(F.array(F.lit(default))) for c in (many, one))


def assembled(fields: Column, latest: Column, leave: list[str], kind: Column) -> Column:
    """A map of the fields but those to leave, overwritten by the latest keys, with the content type."""
    kept = F.map_filter(fields, lambda k, v: ~k.isin(*leave) & ~F.map_contains_key(latest, k) & (k != "content_type"))
    return F.map_concat(kept, F.map_filter(latest, lambda k, v: k != "content_type"), F.create_map(F.lit("content_type"), kind))
