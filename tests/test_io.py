import json
import wave

import numpy as np
import pytest

from tessera.functions import dsp
from tessera.sources import io as S
from tessera.streaming import annotations as A


def test_wave_files(spark, tmp_path):
    for name, width, channels, values in (("a", 2, 1, [0.0, 0.5, -1.0]), ("b", 1, 1, [0.0, 0.5, -0.5]), ("c", 2, 2, [0.5, -0.5, 0.25, 0.75])):
        with wave.open(f"{tmp_path}/{name}.wav", "wb") as w:
            w.setparams((channels, width, 4, 0, "NONE", ""))
            w.writeframes(dsp.to_pcm(np.array(values), width))
    got = {r.path[-5]: r for r in S.read_waveforms(spark, f"{tmp_path}/*.wav").collect()}
    assert np.allclose(got["a"].samples, [0, 0.5, -1]) and got["a"].duration_sec == 0.75
    assert np.allclose(got["b"].samples, [0, 0.5, -0.5]) and np.allclose(got["c"].samples, [0, 0.5]) and got["c"].channels == 2
    d = S.file_digests(spark, f"{tmp_path}/*.wav").collect()
    assert len(d) == 3 and all(len(r.sha256) == 64 for r in d)
    assert dsp.to_pcm([2.0, -2.0], 2) == np.array([32767, -32768], "<i2").tobytes()


def test_predictions_as_lines_and_array(spark, tmp_path):
    (tmp_path / "l/echo/m1").mkdir(parents=True)
    (tmp_path / "l/echo/m1/r.jsonl").write_text('{"clip": 1, "raw": "a\\nb"}\n\n{"clip": 2}\n')
    (tmp_path / "a.json").write_text(json.dumps([{"clip": 3, "raw": None}, {"clip": 4, "raw": "é"}], indent=1))
    lines = S.read_predictions(spark, f"{tmp_path}/l/*/*", "clip long, raw string", 2, 1).orderBy("clip").collect()
    assert [(r.clip, r.raw, r.path_category, r.path_model) for r in lines] == [(1, "a\nb", "echo", "m1"), (2, None, "echo", "m1")]
    assert [r.raw for r in S.read_predictions(spark, f"{tmp_path}/a.json", "clip long, raw string", array=True).orderBy("clip").collect()] == [None, "é"]


def test_manifest_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes('﻿id,text\n1,"a ""q"", b\nc"\n2,\n'.encode())
    r = S.read_manifest(spark, f"{tmp_path}/m.csv", "id long, text string").orderBy("line").collect()
    assert [(x.id, x.text) for x in r] == [(1, 'a "q", b\nc'), (2, None)]


def test_existing_target_is_refused(spark, tmp_path):
    S.write_table(spark.range(2), f"{tmp_path}/t", "json")
    with pytest.raises(Exception, match="(?i)already exists"):
        S.write_table(spark.range(2), f"{tmp_path}/t", "json")


def test_stream_takes_new_files_once(spark, tmp_path):
    items = spark.createDataFrame([("i1", "A"), ("i2", "R")], "item string, truth string")
    assigned = spark.createDataFrame([("ann", "echo")], "annotator string, category string")
    src, out, at = (f"{tmp_path}/{n}" for n in ("src", "out", "at"))
    row = lambda **x: {"annotator": "ann", "category": "echo", "item": "i1", "label": "A", "response_time": 1.0, "replay": 0, "submitted_at": "2024-01-01T00:00:00"} | x

    def add(name, *rows):
        import os

        os.makedirs(src, exist_ok=True)
        with open(f"{src}/{name}.json", "w") as f:
            f.write("\n".join(map(json.dumps, rows)))
        accepted = A.stream_submissions(spark, src, items, assigned).filter("reject_reason is null")
        A.stream_dedup(accepted, out, at).awaitTermination()
        rows = spark.read.schema("item string, label string, outcome string").parquet(out).collect()
        return sorted((r.item, r.label) for r in rows if r.outcome == "kept"), sorted((r.item, r.label, r.outcome) for r in rows if r.outcome != "kept")

    first = [row(submitted_at="2024-01-01T00:00:09"), row(label="R")]  # the earlier one is second in the file
    assert add("a", *first, row(item="i9"), row(annotator="x"), row(label="Q"), row(replay=-1)) == ([("i1", "R")], [("i1", "A", "repeated")])
    late = [("i1", "A", "repeated"), ("i1", "R", "repeated")]
    assert add("b", row(label="R", submitted_at="2023-01-01T00:00:00"), row(item="i2")) == ([("i1", "R"), ("i2", "A")], late)


def test_update_mode_keeps_keys_that_a_batch_leaves_out(spark, tmp_path):
    items, assigned = spark.createDataFrame([("i1", "A")], "item string, truth string"), spark.createDataFrame([("a", "c"), ("b", "c")], "annotator string, category string")
    (tmp_path / "src").mkdir()
    for name, who in (("1", "a"), ("2", "b"), ("3", "b")):
        (tmp_path / f"src/{name}.json").write_text(json.dumps({"annotator": who, "category": "c", "item": "i1", "label": "A", "response_time": 1.0, "replay": 0}))
        summary = A.stream_summary(A.stream_submissions(spark, f"{tmp_path}/src", items, assigned))
        A.run_to(summary, f"{tmp_path}/out", f"{tmp_path}/at", "update")
    last = A.latest(spark.read.parquet(f"{tmp_path}/out"), ["category", "annotator"]).collect()
    assert sorted((r.annotator, r.n_rows) for r in last) == [("a", 1), ("b", 2)]


def test_line_numbers_do_not_depend_on_splits(spark, tmp_path):
    (tmp_path / "m.csv").write_text("id,text\n" + "".join(f"{i},t{i}\n" for i in range(5000)))
    (tmp_path / "n.csv").write_text("id,text\n7,x\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = S.read_manifest(spark, f"{tmp_path}/*.csv", "id long, text string", multi_line=False).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r.line for r in rows if r.file.endswith("m.csv")) == list(range(1, 5001)) and all(r.line == r.id + 1 for r in rows if r.file.endswith("m.csv"))
    assert [r.line for r in rows if r.file.endswith("n.csv")] == [1]


def test_manifest_lines_of_a_split_file(spark, tmp_path):
    """Files of many blocks, an empty one and one of a single row: numbers follow the file, and rows are not shuffled by file."""
    import os

    for name, n in (("a", 9000), ("b", 1), ("c", 0), ("d", 700)):
        with open(tmp_path / f"{name}.csv", "w", encoding="utf-8") as f:
            f.write("name,value\n" + "".join(f"{name}{i},{'x' * (i % 37)}\n" for i in range(1, n + 1)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        t = S.read_manifest(spark, str(tmp_path), "name string, value string", multi_line=False)
        assert t.rdd.getNumPartitions() > 8 and t.columns == ["name", "value", "file", "line"]
        got = t.filter("value <> 'x'").collect()  # a later filter does not renumber
        assert all(r.name[1:] == str(r.line) and os.path.basename(r.file)[0] == r.name[0] for r in got)
        assert t.count() == 9701 and len(got) == 9701 - t.filter("value = 'x' or value is null").count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_waveforms_are_written_through_their_file_system(spark, tmp_path):
    df = spark.createDataFrame([("a", [0.0, 0.5]), ("b", [-0.5])], "clip_id string, samples array<double>")
    for folder in (f"{tmp_path}/x y", f"file:{tmp_path}/z", f"file://{tmp_path}/z"):
        assert S.write_waveforms(df, folder, 8) == 2
    got = {r.path[-5]: r.samples for r in S.read_waveforms(spark, f"{tmp_path}/z/*.wav").collect()}
    assert set(got) == {"a", "b"} and np.allclose(got["a"], [0, 0.5]) and len(list((tmp_path / "x y").iterdir())) == 2
    with pytest.raises(ValueError, match="cannot open nowhere://"):
        S.write_waveforms(df, "nowhere://host/folder", 8)


def test_manifest_texts_come_back_as_they_were(spark, tmp_path):
    """White space at the ends, empty texts beside null ones, line ends, quotes, backslashes and NUL."""
    texts = ["", None, " ", " a\t", "\na\n", "a\r\nb\r", "\r", '"', '""a', 'a"\x00,"', "\x00", "\\", '\\"', "#a", "null", "\x1f,é\x85", "﻿a", ' "x"\n' * 300_000]
    rows = [(i, None if i % 2 else "", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    S.write_table(df, f"{tmp_path}/m", "csv")
    back = S.read_manifest(spark, f"{tmp_path}/m", "doc_id long, lang string, text string").select("doc_id", "lang", "text").collect()
    assert sorted(map(tuple, back)) == rows
