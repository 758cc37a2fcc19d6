"""Log probabilities of texts under a hidden Markov language model trained by Baum-Welch."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, local

#: The end of a text as a token; no word holds white space.
END = b"\n"
#: Most frequent words whose counts are broadcast (the rest is joined), and those of them that are symbols of their own.
HEAD, SYMBOLS = 131_072, 32_768
STATES, ROUNDS = 8, 4
#: How much likelier than a change to any one other state it is, at the start, that a state stays.
STAY = 3000
#: Tokens of a sequence whose chances are held at a time, tokens of a block of sequences, words that a counting task keeps.
SEGMENT, BLOCK, KEPT = 1 << 17, 120_000, 400_000
#: Steps after which chances are scaled anew.
RESCALE = 8
#: Bytes of a word beyond which it is never broadcast, but joined; bits of a count that one pass looks at.
LONG_WORD, DIGIT = 256, 16
#: Weight, in tokens, of the overall frequencies in each state's emissions.
PRIOR = 50.0


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def count_words(docs: DataFrame, text_col: str) -> DataFrame:
    """(word binary, c long) over all rows; a task adds up what it reads and lets go of it every KEPT words."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for part in batches:
            for text in part["text"]:
                held.update(words_of(text))
                if len(held) > KEPT:
                    yield pd.DataFrame({"word": list(held), "c": list(held.values())})
                    held = Counter()
            held[END] += len(part)
        if held:
            yield pd.DataFrame({"word": list(held), "c": list(held.values())})

    parts = docs.select(F.col(text_col).alias("text")).mapInPandas(gather, "word binary, c long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"))


def least_count(counts: DataFrame, head: int) -> int:
    """The smallest count from which on there are at most `head` words (word, c): from the counts' histogram, digit by digit, so
    that at most 2 ** DIGIT rows reach the driver at a time, whatever the counts are."""
    above, taken = 0, 0
    for shift in range(64 - DIGIT, -1, -DIGIT):
        here = counts.where(F.shiftright("c", shift + DIGIT) == above) if shift + DIGIT < 64 else counts
        digits = here.groupBy(F.shiftright("c", shift).bitwiseAND(F.lit((1 << DIGIT) - 1)).alias("d")).agg(F.count("*").alias("n")).collect()
        for d, n in sorted(((r.d, r.n) for r in digits), reverse=True):
            if taken + n > head:
                above = above << DIGIT | d
                break
            taken += n
        else:
            return max(1, above << (shift + DIGIT))  # all that begin with these digits fit
    return above + 1


@dataclass
class Hmm:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # symbols x states

    def blocks(self, sequences: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
        """(numbers, lengths, live, symbols) of sequences of like length, longest first. Symbols stand step by step, without
        padding: those of step t are of the first live[t] sequences."""
        order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
        at = 0
        while at < len(order):
            to, held = at, 0
            while to < len(order) and (to == at or held + len(sequences[order[to]]) <= BLOCK):
                held += len(sequences[order[to]])
                to += 1
            lengths = np.array([len(sequences[i]) for i in order[at:to]])
            live = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")
            begins, symbols = np.cumsum(live) - live, np.empty(held, np.int32)
            for c, i in enumerate(order[at:to]):
                symbols[begins[: lengths[c]] + c] = sequences[i]
            yield order[at:to], lengths, live, symbols
            at = to

    def ratios(self) -> tuple[np.ndarray, np.ndarray]:
        """The chances of each symbol over the largest of them, so that products of a few steps stay in range, and that largest."""
        peak = self.emit.max(1)
        return self.emit / peak[:, None], peak

    def forward(self, seen: np.ndarray, live: list[int], before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Scaled chances of the states with all that was read up to each symbol, and what each row was divided by. seen holds the
        ratios of a block's symbols; before are the chances just before it (none: texts begin here)."""
        alphas, scales, ones = np.empty_like(seen), np.ones(len(seen)), np.ones(len(self.start))
        last = at = 0
        for t, m in enumerate(live):
            now = alphas[at : at + m]
            if t:
                np.matmul(alphas[last : last + m], self.move, out=now)
            else:
                now[:] = self.start if before is None else before @ self.move
            now *= seen[at : at + m]
            if t % RESCALE == 0:
                scales[at : at + m] = now @ ones
                now /= scales[at : at + m, None]
            last, at = at, at + m
        return alphas, scales

    def segments(self, symbols: np.ndarray, ratio: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | None, float]]:
        """(symbols, chances just before, log10 of the scales) of each segment of one long sequence."""
        before = None
        for at in range(0, len(symbols), SEGMENT):
            part = symbols[at : at + SEGMENT]
            alphas, scales = self.forward(ratio[part], [1] * len(part), before)
            end = alphas[-1].sum()
            yield part, before, float(np.log10(scales).sum() + np.log10(end))
            before = alphas[-1] / end

    def log10(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Exact log10 likelihood of each whole sequence, by the scaled forward recursion."""
        out, (ratio, peak) = np.zeros(len(sequences)), self.ratios()
        logs, ones = np.log10(peak), np.ones(len(self.start))
        for i, s in enumerate(sequences):
            if len(s) > SEGMENT:
                out[i] = sum(scale + logs[part].sum() for part, _, scale in self.segments(s, ratio))
        short = [i for i, s in enumerate(sequences) if 0 < len(s) <= SEGMENT]
        for some, lengths, live, symbols in self.blocks([sequences[i] for i in short]):
            alphas, scales = self.forward(ratio[symbols], live.tolist())
            begins = np.cumsum(live) - live
            column = np.arange(len(symbols)) - np.repeat(begins, live)
            ends = alphas[begins[lengths - 1] + np.arange(len(lengths))] @ ones
            out[[short[i] for i in some]] = np.bincount(column, np.log10(scales) + logs[symbols]) + np.log10(ends)
        return out

    def expect_block(self, ratio: np.ndarray, symbols: np.ndarray, live: np.ndarray, starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> np.ndarray:
        """Adds the expected counts of a block of sequences, or of a segment of one between the forward chances before it and
        the backward chances after it; returns the backward chances, up to a factor, before its first row."""
        seen, counts, ones, back = ratio[symbols], live.tolist(), np.ones(len(self.start)), self.move.T.copy()
        alphas, scales = self.forward(seen, counts, before)
        betas, at = np.ones_like(seen), len(seen)
        if after is not None:
            betas[-1] = after
        for t in range(len(counts) - 1, 0, -1):
            m, at = counts[t], at - counts[t]
            here = seen[at : at + m]
            here *= betas[at : at + m]  # seen holds from here on the chance of the symbol and of all that follow
            left = betas[at - counts[t - 1] : at - counts[t - 1] + m]
            np.matmul(here, back, out=left)
            if t % RESCALE == 0:
                left /= (left @ ones)[:, None]
        first = counts[0]
        seen[:first] *= betas[:first]
        betas *= alphas
        total = betas @ ones  # a row of betas over this is the chance of each state, given the whole sequence
        for z in range(len(ones)):
            emits[:, z] += np.bincount(symbols, betas[:, z] / total, len(emits))
        if before is None:
            starts += (betas[:first] / total[:first, None]).sum(0)
        seen /= (total * scales)[:, None]
        if before is not None:
            moves += np.outer(before, seen[0]) * self.move
        moves += (alphas[np.arange(first, len(seen)) - np.repeat(live[:-1], live[1:])].T @ seen[first:]) * self.move
        return seen[0] @ back

    def expect(self, sequences: list[np.ndarray], starts: np.ndarray, moves: np.ndarray, emits: np.ndarray) -> None:
        """Adds the expected counts of the sequences, by scaled forward and backward recursions. Of a long one, forward chances
        are kept only where a segment begins, and found anew, segment by segment from the last, for the backward recursion."""
        ratio, _ = self.ratios()
        for s in sequences:
            if len(s) > SEGMENT:
                after = None
                for part, before, _ in reversed(list(self.segments(s, ratio))):
                    after = self.expect_block(ratio, part, np.ones(len(part), np.int64), starts, moves, emits, before, after)
                    after /= after.sum()
        for _, _, live, symbols in self.blocks([s for s in sequences if 0 < len(s) <= SEGMENT]):
            self.expect_block(ratio, symbols, live, starts, moves, emits)


def maximised(starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, overall: np.ndarray) -> Hmm:
    """The model of expected counts, drawn towards the overall frequencies, so that nothing has chance zero."""
    move = moves + 1.0
    emit = emits + PRIOR * overall[:, None]
    return Hmm((starts + 1.0) / (starts + 1.0).sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0, keepdims=True))


def starting_point(overall: np.ndarray, states: int, seed: int) -> Hmm:
    """States that seldom change and differ by chance from the overall frequencies: no text is looked at but through those."""
    emits = overall[:, None] * np.random.default_rng(seed).gamma(1.0, 1.0, (len(overall), states)) * 100 * PRIOR
    return maximised(np.ones(states), STAY * np.eye(states), emits, overall)


def baum_welch_round(encoded: DataFrame, model: Hmm, overall: np.ndarray) -> Hmm:
    """One round over all rows of encoded (ids): expected counts are added up by task, then across tasks."""
    states, n_symbols = len(model.start), len(overall)
    sent = encoded.sparkSession.sparkContext.broadcast(model)

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts, moves, emits = np.zeros(states), np.zeros((states, states)), np.zeros((n_symbols, states))
        for part in batches:
            sent.value.expect([np.minimum(ids, n_symbols - 1) for ids in part["ids"]], starts, moves, emits)
        some = np.flatnonzero(emits.any(1))
        keys = np.concatenate((some, [-1], np.arange(-2, -2 - states, -1)))
        yield pd.DataFrame(np.concatenate((emits[some], starts[None], moves)).astype(np.float32), columns=[f"s{z}" for z in range(states)]).assign(symbol=keys.astype(np.int32))

    schema = ", ".join(f"s{z} float" for z in range(states)) + ", symbol int"
    sums = encoded.select("ids").mapInPandas(gather, schema).groupBy("symbol").agg(*[F.sum(F.col(f"s{z}").cast("double")).alias(f"s{z}") for z in range(states)])
    sums = local(sums)
    rows, symbol = sums[[f"s{z}" for z in range(states)]].to_numpy(), sums["symbol"].to_numpy()
    starts, moves, emits = np.zeros(states), np.zeros((states, states)), np.zeros((n_symbols, states))
    emits[symbol[symbol >= 0]] = rows[symbol >= 0]
    for s, r in zip(symbol, rows, strict=True):
        if s == -1:
            starts = r
        elif s < -1:
            moves[-2 - s] = r
    return maximised(starts, moves, emits, overall)


def lm_score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, symbols: int = SYMBOLS, states: int = STATES, rounds: int = ROUNDS, seed: int = 29) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    Words of all training texts are counted exactly. The `head` most frequent are broadcast (a bounded list: fewer on
    ties, and none of more than LONG_WORD bytes); counts of all other words are joined to the texts that hold them. Texts are encoded once and written to the
    shared folder. The `symbols` most frequent words are symbols of the model, all others one symbol, within which a
    word has its smoothed share. Baum-Welch starts from states that seldom change and differ by chance (seeded) from the
    frequencies of all training texts, and runs `rounds` rounds over all of these, each a whole sequence of any length;
    expected counts are added up across partitions; no part of the model is fitted on a sample. score is
    the exact log10 likelihood of the whole text, base_score that of smoothed single words. Null and empty texts are
    their end alone; repeated rows get a row each; null ids stay; without training texts every word is
    unseen and scores are finite all the same (base 0); no rows
    give no rows. Other columns of docs are left out.
    """
    spark = docs.sparkSession
    counts = cut(count_words(docs.where(train), text_col), "counts")
    n_all, n_distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    brief = F.octet_length("word") <= LONG_WORD
    least = least_count(counts.where(brief), head)
    listed = {bytes(r.word): r.c for r in counts.where((F.col("c") >= least) & brief | (F.col("word") == F.lit(END))).collect()}
    listed.setdefault(END, 0)
    ordered = sorted(listed, key=lambda w: (-listed[w], w))
    number, rare = {w: i for i, w in enumerate(ordered)}, len(ordered)
    c_head = np.array([listed[w] for w in ordered], np.float64)
    log_c = np.append(np.log10(c_head + 0.5), 0.0)
    n_own = min(symbols, rare)
    own = float(c_head[:n_own].sum())
    log_all = float(np.log10(n_all + 0.5 * (n_distinct + 1)))
    n_rest = n_distinct - int((c_head[:n_own] > 0).sum())  # distinct training words without a symbol of their own
    log_rare = float(np.log10((n_all - own) + 0.5 * (n_rest + 1)))
    overall = np.append(c_head[:n_own] + 0.5, n_all - own + 0.5)
    overall /= overall.sum()
    sent = spark.sparkContext.broadcast(number)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = sent.value.get
        end = sent.value[END]
        for part in batches:
            for start in range(0, len(part), 1000):
                some = part.iloc[start : start + 1000]
                ids, tails, tail_ns = [], [], []
                for text in some["text"]:
                    words = words_of(text)
                    line = np.fromiter(map(get, words, repeat(rare)), np.int32, len(words))
                    tail = Counter([words[i] for i in np.flatnonzero(line == rare).tolist()])
                    ids.append(np.append(line, np.int32(end)))
                    tails.append(list(tail))
                    tail_ns.append(list(tail.values()))
                yield pd.DataFrame({"row": some["row"], "doc_id": some["doc_id"], "train": some["train"], "ids": ids, "tail": tails, "tail_n": tail_ns})

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
    encoded = cut(rows.mapInPandas(encode, f"row long, doc_id {id_type}, train boolean, ids array<int>, tail array<binary>, tail_n array<int>"), "encoded")
    learned = encoded.where("train")
    model = starting_point(overall, states, seed)
    for _ in range(rounds):
        model = baum_welch_round(learned, model, overall)
    final = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            known = c_head > 0
            lines = list(part["ids"])
            rest = [x[x < rare] for x in lines]
            scored = final.value.log10([np.minimum(x, n_own) for x in lines])
            yield pd.DataFrame({
                "row": part["row"], "doc_id": part["doc_id"], "n_tokens": [len(x) for x in lines], "known": [int(known[x].sum()) for x in rest],
                "base": [log_c[x].sum() for x in rest], "lm": [s + log_c[x[x >= n_own]].sum() for s, x in zip(scored, rest, strict=True)],
                "n_rare": [int((x >= n_own).sum()) for x in lines],
            })

    scores = encoded.select("row", "doc_id", "ids").mapInPandas(score, f"row long, doc_id {id_type}, n_tokens long, known long, base double, lm double, n_rare long")
    tail = encoded.select("row", F.explode(F.arrays_zip("tail", "tail_n")).alias("t")).select("row", F.col("t.tail").alias("word"), F.col("t.tail_n").alias("n"))
    seen = counts.where((F.col("c") < least) | ~brief).select(F.col("word").alias("_word"), "c")
    tail = tail.join(seen, F.col("word") == F.col("_word"), "left").groupBy(F.col("row").alias("_row")).agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("_log"), F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("_known")
    )
    out = scores.join(tail, F.col("row") == F.col("_row"), "left").na.fill(0, ["_log", "_known"])
    return out.select(
        "doc_id", "n_tokens", (F.col("known") + F.col("_known")).cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("_log") - F.col("n_tokens") * F.lit(log_all)).alias("base_score"),
        (F.col("lm") + F.col("_log") - F.col("n_rare") * F.lit(log_rare)).alias("score"),
    )
