"""Every operator on one table of odd rows: nulls, repeated rows and ids, a very long text, clashing column names."""

import pytest

from tessera.llm import bpe, decontaminate, interleave, langid, licenses, near, pii, ppm, repeats, toxicity

LONG = " ".join(f"word{i % 977}x{i}" for i in range(60_000)) + " you idiot. jo@example.org 4111111111111111 apache license"
ROWS = [
    (1, None, None, None), (1, "", "en", "a"), (1, "", "en", "a"), (None, "no id", "de", None), (None, None, None, None), (2, LONG, "en", "a"), (3, LONG + " end", None, "b"),
    (4, "\x00\x01  ﻿ \U0001f600 é", "fr", ""), (5, "tie tie tie tie tie tie", "de", "a"), (5, "tie tie tie tie tie tie", "de", "a"), (-7, " ", "", "a"),
]
EXTRA = "n_tokens score key sig pos text_ word bucket n __text class_id lang_pred predicted n_pii hits ref payload_bytes start_word rid tail".split()

RUNS = {
    "ppm": lambda s, d: ppm.held_out_score(d),
    "langid": lambda s, d: langid.identify(d),
    "bpe": lambda s, d: bpe.encode(d),
    "pii": lambda s, d: pii.pseudonymize(d, b"k"),
    "near": lambda s, d: near.near_copies(d),
    "decontaminate": lambda s, d: decontaminate.contamination(d, s.createDataFrame([(None, None), (None, "no id"), (1, "word0x0 word1x1")], "item_id long, text string")),
    "licenses": lambda s, d: licenses.scan(d, spans=True),
    "toxicity": lambda s, d: toxicity.score(d, s.createDataFrame([(None, 1), (1, None), (2, 1), (2, 0), (5, 0)], "doc_id long, toxic int"), clauses=True),
    "interleave": lambda s, d: interleave.media_of_documents(d),
}


@pytest.fixture(scope="module")
def odd(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(7) for c in EXTRA if c != "__text"})


@pytest.mark.parametrize("name", list(RUNS))
def test_a_row_for_every_row(spark, odd, name):
    got = RUNS[name](spark, odd).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, *_ in ROWS)
    assert RUNS[name](spark, odd.limit(0)).count() == 0


def test_results_of_the_long_texts(spark, odd):
    by = {r.doc_id: r for r in near.near_copies(odd).collect()}
    assert by[2].class_id == by[3].class_id == 2 and by[2].n_links == 1 and by[5].n_copies == 2
    assert sorted(r.doc_id for r in repeats.repeated_passages(odd).collect()) == [2, 3]
    assert {r.doc_id: r.n_pii for r in pii.pseudonymize(odd, b"k").collect()}[2] == 2
    assert {r.doc_id: r.base_labels for r in licenses.scan(odd).collect()}[2] == "apache"
