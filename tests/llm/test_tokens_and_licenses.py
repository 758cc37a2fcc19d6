import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corvane.llm.common import ship
from corvane.llm.license_scan import license_scan, templates
from corvane.llm.token_count import count_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


def odd_texts():
    rng = random.Random(3)
    letters = "aAbBeEtT  \n\t.,'’!?0123456789éÉßİΣσς中文字😀़ा́‍  -_<|>endofxtΩ"
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 60))) for _ in range(800)]
    return made + [
        None, "", " ", "<|startoftext|>hello<|endoftext|>", "it's we'll I'M don’t", "x" * 5000, "ΑΣ ΟΔΟΣ", "a" * 200 + " " + "b",
        "<|startoftext", "1234 ab12cd", "é" * 70,
    ]


def test_token_counts_equal_the_library(spark):
    ship(spark)
    texts = odd_texts()
    rows = count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH).collect()
    library = Tokenizer.from_file(PATH)
    library.no_truncation(), library.no_padding()
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert {r.doc_id: r.n_tokens for r in rows} == dict(enumerate(want))
    assert {r.doc_id: r.n_bytes for r in rows} == {i: len((t or "").encode()) for i, t in enumerate(texts)}


def test_token_counts_on_real_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    library = Tokenizer.from_file(PATH)
    want = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in count_tokens(docs, PATH).collect()} == want


def test_token_counts_of_clashing_columns_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b", 7)], "doc_id long, text string, n_tokens int")
    row = count_tokens(docs, PATH).first()
    assert (row.n_tokens, row.over_limit) == (2, False)
    assert count_tokens(docs.limit(0), PATH).count() == 0


def brute_license(text):
    import re

    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    places, base = [], set()
    for _, phrase, label, is_base in templates():
        p = phrase.split()
        if is_base:
            found = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
            places += found
            base |= {label} if found else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base))


@pytest.mark.parametrize("extra", [False, True])
def test_license_places(spark, extra):
    texts = [
        None, "", "cc", "CC BY", "cc by cc by cc by", "All rights reserved. all RIGHTS\nreserved", "all rights all rights reserved",
        "Licensed under the Apache License, Version 2.0. É cc-by", "GNU General Public License, general public", "word " * 3000 + "cc by",
        "Released under the very MIT License", "all rights reserved " * 500,
    ]
    rows = list(enumerate(texts)) + [(3, "CC BY"), (None, "cc by")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        docs = docs.withColumns({"label": F.lit("x"), "n": F.lit(1), "mask": F.lit(2), "score": F.lit(3)})
    got = [tuple(r)[:6] for r in license_scan(docs).collect()]
    want = [(i, *brute_license(t)) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    labels = {r.doc_id: r.labels for r in license_scan(docs).collect()}
    assert labels[7] == "apache-2.0,cc-by" and labels[10] == "mit" and labels[0] == ""
    assert license_scan(docs.limit(0)).count() == 0
