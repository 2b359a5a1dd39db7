import os
import zlib

import corpus_pipeline as p
from pyspark.sql import functions as F
from tests.llm.test_near import brute as near_brute
from tessera.llm import decontaminate, pii
from tessera.llm.bpe import load, vocabulary_path


def test_stages_against_brute_force(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    columns = docs.columns
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_small}/labels.parquet").collect()}
    before = docs.collect()
    first = p.reject_toxic(spark, docs, sf_small).collect()
    assert {r.doc_id for r in first} <= {r.doc_id for r in before}
    gone = {r.doc_id for r in before} - {r.doc_id for r in first}
    assert not [i for i in gone if labels.get(i) == 0 and zlib.crc32(str(i).encode()) % 3 != 1]
    second = p.drop_near_copies(spark, spark.createDataFrame(first, docs.schema), sf_small).collect()
    want = near_brute([(r.doc_id, r.text) for r in first])
    assert sorted(r.doc_id for r in second) == sorted(i for i, x in want.items() if x[0] == i)
    third = p.reject_contaminated(spark, spark.createDataFrame(second, docs.schema), sf_small).collect()
    bad = decontaminate.brute([r.text for r in second], items)
    assert sorted(r.doc_id for r in third) == sorted(r.doc_id for r, x in zip(second, bad, strict=True) if not x[4])
    fourth = p.mask_private(spark, spark.createDataFrame(third, docs.schema), sf_small).collect()
    masker = pii.Masker(pii.session_key(spark))
    texts = {r.doc_id: masker.mask(r.text)[0] for r in third}
    assert {r.doc_id: r.text for r in fourth} == texts and all(r.n_chars == len(r.text) for r in fourth)
    last = p.encode(spark, spark.createDataFrame(fourth, docs.schema), sf_small)
    assert set(columns) < set(last.columns)
    bpe = load(vocabulary_path())
    assert {r.doc_id: r.n_tokens for r in last.collect()} == {i: sum(x[0] for x in bpe.encode_texts([t])[0]) for i, t in texts.items()}
    assert sorted(r.doc_id for r in p.run(spark, sf_small).select("doc_id").collect()) == sorted(texts)


def test_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (1, None, "en", "s", 0), (2, "", None, None, 0), (None, "a b c d e f", None, None, 11), (None, "a b c d e f", None, None, 11)]
    rows += [(5, "same text of some five words", "en", "s", 28), (5, "same text of some five words", "en", "s", 28), (6, "Same text, of some five words", "en", "s", 29)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = p.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, "a b c d e f"), (1, ""), (1, ""), (2, ""), (5, "same text of some five words")]


CLASHING = "n __text score predicted n_words hits matches n_hit n_items items_sha256 contaminated n_pii pii_kinds values __row __salt"
CLASHING = [*CLASHING.split(), "key sig", "a.b", "a`b", "row_id", "class_id", "n_links", "times", "digest"]


def test_columns_of_any_name_come_back_as_they_were(spark, tmp_path):
    rows = [(i, f"a text of some {i} words that nobody else has {i * i} {i + 7}", i) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumns({c: F.lit(f"own {c}") for c in CLASHING})
    docs = docs.withColumn("more", F.create_map(F.lit("k"), F.col("doc_id")))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in p.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns
        for r in got.collect():
            assert [r[c] for c in CLASHING] == [f"own {c}" for c in CLASHING] and r.more == {"k": r.doc_id}
    last = p.run(spark, str(tmp_path)).collect()
    assert len(last) == 6 and all([r[c] for c in CLASHING] == [f"own {c}" for c in CLASHING] for r in last)


def test_of_rows_with_one_id_and_text_the_same_one_stays(spark):
    rows = [(5, "same text of some five words", x) for x in ("b", "a", "c")] + [(4, "Same text of some, five words", "z")]
    for n in (1, 3):
        d = spark.createDataFrame(rows[:3], "doc_id long, text string, lang string").repartition(n)
        assert len({tuple(p.drop_near_copies(spark, d, "").collect()) for _ in range(2)}) == 1
    got = p.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect()
    assert [(r.doc_id, r.lang) for r in got] == [(4, "z")]


def test_files_of_earlier_stages_are_gone(spark, sf_small):
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    p.run(spark, sf_small)
    assert len({x for x in os.listdir(folder) if not x.startswith(".")} - before) == 1
