import collections
import random
import zlib

import numpy as np
import pytest
import xxhash

from tessera.llm import shards as m
from tessera.llm.queries import op13_shards


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def key_of(i):
    return 42 if i is None else xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), seed=42)


def check(got, rows, n):
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    by = collections.defaultdict(list)
    for r in got:
        assert (r.law, r.shard, r.grown_shard) == ("key", jump(key_of(r.doc_id), n), jump(key_of(r.doc_id), n + 1))
        assert r.grown_shard in (r.shard, n)
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_jump_as_published():
    keys = np.array([0, 1, 2**64 - 1, *(random.Random(1).getrandbits(64) ^ i << 40 for i in range(500))], np.uint64)
    for n in (1, 2, 7, 16, 17, 1000, 100_003):
        assert m.jump(keys, n).tolist() == [jump(int(k), n) for k in keys]
    assert m.jump(np.array([], np.uint64), 5).tolist() == []
    with pytest.raises(ValueError, match="at least one"):
        m.jump(keys, 0)


def test_odd_rows_and_a_hot_id(spark, monkeypatch):
    monkeypatch.setattr(m, "COPY_BLOCK", 7)
    rng = random.Random(3)
    rows = [(None, None), (None, "x"), (1, None), (1, ""), (1, "é\U0001f600"), (-5, "a" * 300_000)] + [(rng.randrange(-(2**63), 2**63), "t") for _ in range(900)]
    rows += [(7, "same")] * 500 + [(7, f"other {i % 300}") for i in range(400)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, shard int, slot int")
    got = m.assign(df, 5).collect()
    check(got, rows, 5)
    again = m.assign(df.repartition(13), 5).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again))  # no matter how rows lie
    assert m.assign(df.limit(0)).count() == 0


def test_the_query_on_its_table(spark, sf_small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    got = op13_shards(spark, sf_small).collect()
    check(got, rows, 16)
    assert sum(r.size for r in got) == sum(len((t or "").encode()) + 1 for _, t in rows)


def test_files_hold_whole_rows(spark, tmp_path):
    rows = [(i, f"text {i}", None if i % 3 else "de") for i in range(200)] + [(None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m.write_shards(df, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(map(repr, ((r.doc_id, r.text, r.lang) for r in back))) == sorted(map(repr, rows))
    assert all(r.shard == jump(key_of(r.doc_id), 4) for r in back)
    with pytest.raises(Exception, match="(?i)exists"):
        m.write_shards(df, str(tmp_path / "out"), 4)
    with pytest.raises(ValueError, match="named shard"):
        m.write_shards(df.withColumnRenamed("lang", "shard"), str(tmp_path / "new"), 4)
