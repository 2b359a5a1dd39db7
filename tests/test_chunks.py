import hashlib
import os
import random

import pytest

from tessera.operators import scoring as M
from tessera.plans import catalog
from tessera.sources import chunks as K
from tessera.sources import io as S

sha = lambda b: hashlib.sha256(b).hexdigest()


def tree(leaves):
    nodes = [sha("\n".join(leaves[i : i + K.FAN]).encode()) for i in range(0, len(leaves), K.FAN)]
    return sha("\n".join(nodes).encode())


def plain(data, chunk):
    return tree([sha(data[i : i + chunk]) for i in range(0, len(data), chunk)])


def test_ranges_and_digests(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    data = {"a.bin": rng.randbytes(10_007), "b.bin": b"", "c d.bin": rng.randbytes(3), "é.bin": rng.randbytes(4096)}
    for name, body in data.items():
        (tmp_path / name).write_bytes(body)
    df = K.read_chunks(spark, f"{tmp_path}/*.bin", 1000, 3500)
    assert df.rdd.getNumPartitions() == 4 + 1 + 1 + 2
    got = {}
    for r in df.collect():
        got.setdefault(os.path.basename(r.path), {})[r.chunk] = bytes(r.content)
    assert {n: b"".join(c[i] for i in range(len(c))) for n, c in got.items()} == {n: b for n, b in data.items() if b}
    for fan in (4096, 3):
        monkeypatch.setattr(K, "FAN", fan)
        for size in (1000, 20_000):
            found = {os.path.basename(r.path): (r.size, r.n_chunks, r.sha256) for r in K.tree_digests(spark, str(tmp_path), 1000, size).collect()}
            assert found == {n: (len(b), -(-len(b) // 1000), plain(b, 1000) if b else sha(b"")) for n, b in data.items()}
    with pytest.raises(FileNotFoundError):
        K.read_chunks(spark, f"{tmp_path}/none*")


def test_a_file_beyond_two_gigabytes(spark, tmp_path):
    n = (2 << 30) + 5_000_001
    with open(tmp_path / "big", "wb") as f:
        f.truncate(n)
    r = K.tree_digests(spark, f"{tmp_path}/big", size=64 << 20).first()
    rest = n % K.CHUNK
    assert (r.size, r.n_chunks) == (n, n // K.CHUNK + 1) and r.sha256 == tree([sha(bytes(K.CHUNK))] * (n // K.CHUNK) + [sha(bytes(rest))])
    assert K.read_chunks(spark, f"{tmp_path}/big", size=64 << 20).rdd.getNumPartitions() == 33


def test_against_a_manifest(spark, tmp_path):
    for name in "abcd":
        (tmp_path / name).write_text(name)
    found = S.file_digests(spark, str(tmp_path)).selectExpr("substring_index(path, '/', -1) AS path", "sha256")
    manifest = spark.createDataFrame([("a", sha(b"a").upper()), ("b", sha(b"x")), ("c", None), ("e", sha(b"e"))], "path string, sha256 string")
    assert {r.path: r.status for r in K.compare_digests(found, manifest).collect()} == {"a": "same", "b": "changed", "c": "unrecorded", "d": "unlisted", "e": "missing"}


def test_the_query_against_plain_reading(spark, sf_small):
    got = {r.name: (r.size, r.n_chunks, r.sha256) for r in catalog.queries()["s10_tree_digests"](spark, sf_small).collect()}
    for t in ("documents", "events", "lineitem"):
        with open(f"{sf_small}/{t}.parquet", "rb") as f:
            body = f.read()
        assert got[f"{t}.parquet"] == (len(body), -(-len(body) // 65_536), plain(body, 65_536))


def test_manifest_paths(spark):
    rows = [("m/a.jsonl",), ("m/a.json",), ("m/b.jsonl",), ("m/b.jsonl",), ("/m/c.jsonl",), ("m/../d.jsonl",), ("m/e..f.jsonl",), ("m/.g",), ("",), (None,)]
    got = sorted((r.path or "", r.violation) for r in M.check_manifest(spark.createDataFrame(rows, "path string")).collect())
    assert got == [("", "empty_path"), ("", "empty_path"), ("/m/c.jsonl", "unsafe_path"), ("m/../d.jsonl", "unsafe_path"), ("m/a.json", "colliding_output"), ("m/a.jsonl", "colliding_output"), ("m/b.jsonl", "repeated_path")]


def test_stored_options(spark):
    nan = float("nan")
    rows = [
        ("ok", {"A": 1.0, "B": 1.0}, "joy", "A", "joy"), ("stale", {"A": 1.0, "B": 2.0}, "joy", "A", "joy"), ("gold", {"A": 1.0, "B": 0.0}, "odd", None, None), ("nan", {"A": nan, "B": 0.0}, "joy", "B", "fear"),
        ("less", {"A": 1.0}, "joy", None, None), ("more", {"A": 1.0, "B": 0.0, "C": 0.0}, "joy", None, None), ("none", None, "joy", None, None), ("twice", {"A": 1.0, "B": 0.0}, "joy", None, None), ("twice", {"A": 1.0, "B": 0.0}, "joy", None, None),
    ]
    df = spark.createDataFrame(rows, "id string, scores map<string,double>, gold string, option string, stored string")
    got = sorted(tuple(r) for r in M.check_options(df, "id", "scores", "AB", ("joy", "fear"), "gold", "option", "stored").collect())
    assert got == sorted([("stale", "stored_option"), ("stale", "stored_label"), ("gold", "invalid_gold"), *[(k, "invalid_scores") for k in ("nan", "less", "more", "none")], ("twice", "duplicate_id")])


def test_a_plain_digest_beyond_two_gigabytes(spark, tmp_path):
    """Files of any size, packed ones as they lie there, names that URIs escape, a folder, wildcards, a scheme that only Spark reads."""
    n, whole = (2 << 30) + 5_000_001, hashlib.sha256()
    with open(tmp_path / "big", "wb") as f:
        f.truncate(n)
    for at in range(0, n, 64 << 20):
        whole.update(bytes(min(64 << 20, n - at)))
    data = {"é 1%20#.bin": b"x" * 9_000_000, "none.bin": b"", "z.gz": b"\x1f\x8b not packed", "_hidden": b"left out"}
    for name, body in data.items():
        (tmp_path / name).write_bytes(body)
    want = {"big": (n, whole.hexdigest())} | {k: (len(b), sha(b)) for k, b in data.items() if b and k != "_hidden"}
    tell = lambda df: {os.path.basename(r.path): (r.size, r.sha256) for r in df.collect()}
    assert tell(S.file_digests(spark, str(tmp_path))) == want
    assert tell(S.file_digests(spark, [f"file:{tmp_path}/*.bin", f"{tmp_path}/z.gz"])) == {k: v for k, v in want.items() if k != "big"}
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.digests.link./in", f"file://{tmp_path}")
    assert tell(S.file_digests(spark, "viewfs://digests/in/z.gz")) == {"z.gz": want["z.gz"]}
    assert spark.read.format("binaryFile").load(f"{tmp_path}/z.gz").select("path").first().path == S.file_digests(spark, f"{tmp_path}/z.gz").first().path
