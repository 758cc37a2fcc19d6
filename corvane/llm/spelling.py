"""Spelling variants: words one edit apart, found by merging the light subtrees of their trie with one error allowed."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, release, settled
from .sql_parts import crc32_of, crc32_tables

#: A word is a maximal run of these; only A-Z are lower-cased.
RUN = "[A-Za-zÀ-ÿ]"
#: Different words that a task counts before it passes them on.
KEPT_WORDS = 200_000
#: In every so manieth run of a document, by checksum, one letter is left out.
SLIP = 199


def slipped(ident: str, run: str) -> str:
    """The run, or, if SLIP divides the checksum of `ident:run`, the run without the letter that the checksum names."""
    h = zlib.crc32(f"{ident}:{run}".encode())
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, id_col: str, text_col: str, least_length: int) -> DataFrame:
    """word, n over all texts, for words of at least least_length code points. Counted in the task before the shuffle."""
    lower = str.maketrans(UPPER, LOWER)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(RUN + "{%d,}" % least_length).findall
        total: Counter = Counter()

        def passed_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for b in batches:
            for ident, text in zip(b.column("ident"), b.column("text")):
                if not text.is_valid:
                    continue
                doc = ident.as_py()
                for run, n in Counter(find(text.as_py().translate(lower))).items():
                    word = slipped(doc, run)
                    if len(word) >= least_length:
                        total[word] += n
                if len(total) >= KEPT_WORDS:
                    yield passed_on()
        yield passed_on()

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("ident"), F.col(text_col).alias("text"))
    return rows.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def light_entries(words: DataFrame) -> DataFrame:
    """stem, letter, rest, heavy, word, n: each word at each node of the trie of words where it leaves the heavy path.

    stem is the node's prefix, heavy the letter to its largest subtree (ties: the smallest letter), letter the word's own
    next letter, null where the word ends at the node, rest what follows that letter. Each step off a heavy path at least
    halves the subtree, so a word has at most log2 of the number of words such entries: merging small subtrees to large.
    """
    at = F.posexplode(F.expr("transform(sequence(1, char_length(word)), i -> substring(word, i, 1))")).alias("depth", "letter")
    steps = words.select("word", "n", at).select("word", "n", "letter", "depth", F.expr("substring(word, 1, depth)").alias("stem"))
    nodes = steps.groupBy("stem", "letter").agg(F.count("*").alias("size"))
    ends = words.select(F.col("word").alias("stem"), F.lit(None).cast("string").alias("letter"), F.lit(0).cast("long").alias("size"))
    best = F.max(F.when(F.col("letter").isNotNull(), F.struct("size", (-F.ascii("letter")).alias("low"), "letter")))
    forks = nodes.unionByName(ends).groupBy("stem").agg(best.alias("best"), F.count("*").alias("ways")).where("ways > 1 AND best IS NOT NULL")
    forks = settled(forks.select(F.col("stem").alias("_stem"), F.col("best.letter").alias("heavy")), "forks")  # a table of its own, so that the join's crowded stems can be split
    leaving = steps.select("stem", "letter", F.expr("substring(word, depth + 2)").alias("rest"), "word", "n")
    leaving = leaving.unionByName(words.select(F.col("word").alias("stem"), F.lit(None).cast("string").alias("letter"), F.lit("").alias("rest"), "word", "n"))
    return leaving.join(forks, (F.col("stem") == F.col("_stem")) & ((F.col("letter") != F.col("heavy")) | F.col("letter").isNull())).drop("_stem")


def one_edit(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For words (word, n; words distinct): what light subtrees find of each other, and of what heavy paths hold.

    First: (word, near, near_n), a row for each pair and direction that involves a heavy path or a skipped letter.
    Second: (word, n_near, best, best_n), pairs of two light words that differ in one letter, told as each word's number
    of partners and best partner; such words meet in groups of at most one per letter of the alphabet, and are not paired.

    A pair differs first at the node of its longest common prefix, so it is found there and only there: by the heavy
    letter in place of the light word's, by the light word's letter left out, by the heavy letter put before the rest.
    """
    light = settled(light_entries(words), "light")
    own = F.coalesce(F.col("letter"), F.lit(""))
    replaced = F.when(F.col("letter").isNotNull(), F.concat("stem", "heavy", "rest"))
    skipped = F.when(F.col("letter").isNotNull() & (F.substring("rest", 1, 1) != F.col("letter")), F.concat("stem", "rest"))
    put_in = F.concat(F.col("stem"), F.col("heavy"), own, F.col("rest"))
    asked = light.select("word", "n", F.explode(F.array_compact(F.array(replaced, skipped, put_in))).alias("near"))
    found = asked.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    both = found.select(F.explode(F.array(
        F.struct("word", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))).alias("p")).select("p.*")
    merged = light.where("letter IS NOT NULL").groupBy("stem", "rest").agg(F.count("*").alias("size"), F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "word", "letter"))).alias("all")).where("size > 1")
    each = merged.select("size", F.col("all")[0].alias("top"), F.col("all")[1].alias("next"), F.explode("all").alias("own"))
    best = F.when(F.col("own.word") != F.col("top.word"), F.col("top")).otherwise(F.col("next"))
    grouped = each.select(F.col("own.word").alias("word"), (F.col("size") - 1).alias("n_near"), best["word"].alias("best"), (-best["less"]).alias("best_n"))
    return both, grouped


def with_roots(forms: DataFrame, rounds: int = 40) -> DataFrame:
    """forms (word, form, ...) with root: from a word by forms to the last. Steps double each round, so that chains of
    2 ** rounds forms would end; a form occurs at least five times as often, so chains are short."""
    out = settled(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    for _ in range(rounds):
        on = out.where("root != word").select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        if on.join(on.select(F.col("_r").alias("_w")).distinct(), "_w", "left_semi").isEmpty():  # no root has a form of its own
            break
        before, out = out, settled(out.join(on, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root")), "roots")
        release(before)
    return forms.join(out, "word")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_count: int = 5, factor: int = 5) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are runs of letters of whole texts, lower-cased in A-Z, now and then with one letter left out by a checksum of
    document and run; kept are those of at least least_length code points and least_count occurrences over all texts.
    n_near counts the words one inserted, deleted or replaced code point away; form is the one of them of largest n
    (ties: smallest in code-point order), if it occurs `factor` times as often as the word; root follows forms to the
    last. Found by errata-trie merging; no group of words is paired with itself. Null texts have no words, a null id
    counts as empty text, repeated rows count as often as they occur, no rows give no rows; other columns are left out.
    """
    words = settled(word_counts(docs, id_col, text_col, least_length).where(F.col("n") >= least_count), "words")
    pairs, grouped = one_edit(words)
    told = pairs.select("word", F.lit(1).cast("long").alias("n_near"), F.col("near").alias("best"), F.col("near_n").alias("best_n")).unionByName(grouped)
    near = told.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))).alias("b"))
    near = near.select(F.col("word").alias("_word"), "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n"))
    enough = F.col("best_n") >= F.lit(factor) * F.col("n")
    forms = words.join(near, F.col("word") == F.col("_word"), "left").select(
        "word", F.when(enough, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best_n")).alias("form_n"))
    return with_roots(settled(forms, "forms")).select("word", "form", "root", "n", "n_near", "form_n")


def oracle(least_length: int = 6, least_count: int = 5, factor: int = 5) -> str:
    """The same over documents as DuckDB SQL: words meet where one letter is left out of, or masked in, both."""
    return f"""
WITH RECURSIVE run AS (SELECT doc_id::VARCHAR || ':' || r AS k, r, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS r FROM documents) WHERE length(r) >= {least_length} GROUP BY ALL),
{crc32_tables("(SELECT max(strlen(k)) FROM run)")},
code AS ({crc32_of("run", "k")}),
slip AS (SELECT CASE WHEN crc % {SLIP} = 0 THEN left(r, (crc % length(r))::BIGINT) || substr(r, (crc % length(r))::BIGINT + 2) ELSE r END AS word, c FROM run JOIN code USING (k)),
words AS (SELECT word, sum(c)::BIGINT AS n FROM slip WHERE length(word) >= {least_length} GROUP BY word HAVING sum(c) >= {least_count}),
spot AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
mask AS (SELECT word, n, left(word, i - 1) || '*' || substr(word, i + 1) AS m FROM spot),
gone AS (SELECT DISTINCT word, n, left(word, i - 1) || substr(word, i + 1) AS m FROM spot),
pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM mask a JOIN mask b ON a.m = b.m AND a.word != b.word
  UNION ALL SELECT a.word, b.word, b.n FROM gone a JOIN words b ON a.m = b.word UNION ALL SELECT b.word, a.word, a.n FROM gone a JOIN words b ON a.m = b.word),
ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS p, count(*) OVER (PARTITION BY word) AS n_near FROM pairs),
forms AS (SELECT w.word, CASE WHEN near_n >= {factor} * w.n THEN near END AS form, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= {factor} * w.n THEN near_n END AS form_n FROM words w LEFT JOIN (FROM ranked WHERE p = 1) r ON r.word = w.word),
chain(word, reached, step) AS (SELECT word, word, 0 FROM forms UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN forms f ON f.word = c.reached WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, arg_max(reached, step) AS root FROM chain GROUP BY word) USING (word)"""
