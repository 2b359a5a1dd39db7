"""Keyed state of the annotation streams: results after every batch, and what a batch reads."""

import itertools
import json
import os
import random

import pandas as pd

from tessera.operators import labels as L
from tessera.streaming import annotations as A

ROW = {"category": "echo", "response_time": 1.0, "replay": 0}


def write(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w") as f:
        f.write("\n".join(json.dumps(ROW | r) for r in rows))


def log(spark, folder, items, annotators):
    known = spark.createDataFrame([(f"i{i}", "A") for i in range(items)], "item string, truth string")
    assigned = spark.createDataFrame([(f"p{a}", "echo") for a in range(annotators)], "annotator string, category string")
    return A.stream_submissions(spark, folder, known, assigned).filter("reject_reason is null")


def test_agreement_after_every_batch(spark, tmp_path):
    rng, path = random.Random(5), str(tmp_path)
    seen, last = {}, {}
    for batch in range(3):
        rows = []
        for i, a in rng.sample(list(itertools.product(range(4), range(9))), 20):
            rows.append({"item": f"i{i}", "annotator": f"p{a}", "label": rng.choice("AR"), "submitted_at": f"2024-01-01T00:00:{len(rows):02d}"})
        rows += [r | {"label": "A" if r["label"] == "R" else "R", "submitted_at": "2024-01-01T00:01:00"} for r in rows[:5]]  # later in the same batch
        write(f"{path}/src", str(batch), rows)
        for r in rows:
            seen.setdefault((r["item"], r["annotator"]), r["label"])
        A.stream_dedup(log(spark, f"{path}/src", 4, 9), f"{path}/first", f"{path}/c1").awaitTermination()
        A.run_to(A.stream_agreement(A.stream_kept(spark, f"{path}/first")), f"{path}/items", f"{path}/c2", "update")
        A.run_to(A.stream_pairs(A.stream_kept(spark, f"{path}/first"), "A", 3), f"{path}/pairs", f"{path}/c3")
        told = spark.readStream.schema("item string, a string, b string, same long, pa long, pb long").parquet(f"{path}/pairs")
        A.run_to(A.stream_pair_agreement(told), f"{path}/scores", f"{path}/c4", "update")
        own = spark.createDataFrame([(*k, v) for k, v in seen.items()], "item string, annotator string, label string")
        want = {r.item: (r.n_labels, r.majority, r.agreement) for r in L.item_consensus(own, "item", "label").collect()}
        last |= {r.item: (r.n_labels, r.majority, r.agreement) for r in A.latest(spark.read.parquet(f"{path}/items"), ["item"]).collect()}
        assert last == want
        scores = {(r.a, r.b): (r.n_shared, r.agreement, r.kappa) for r in A.latest(spark.read.parquet(f"{path}/scores"), ["a", "b"]).collect()}
        assert scores == {(r.a, r.b): (r.n_shared, r.agreement, r.kappa) for r in L.pairwise(own, "annotator", "item", "label", "A").collect()}
    kept = spark.read.parquet(f"{path}/first").filter("outcome = 'kept'").collect()
    assert {(r.item, r.annotator): r.label for r in kept} == seen and len(kept) == len(seen)


def test_a_batch_reads_nothing_that_was_stored(spark, tmp_path):
    path, n = str(tmp_path), 6000
    write(f"{path}/src", "0", [{"item": f"i{i}", "annotator": f"p{a}", "label": "A"} for i in range(n) for a in range(2)])
    q = A.stream_dedup(log(spark, f"{path}/src", n, 3), f"{path}/first", f"{path}/c1")
    q.awaitTermination()
    A.run_to(A.stream_pairs(A.stream_kept(spark, f"{path}/first"), "A", 1), f"{path}/pairs", f"{path}/c2")
    def files(folder):
        return [f"{at}/{name}" for at, _, names in os.walk(folder) for name in names if name.endswith(".parquet")]

    for name in [*files(f"{path}/first"), *files(f"{path}/pairs"), f"{path}/src/0.json"]:  # what earlier batches read or wrote is gone
        os.remove(name)
    write(f"{path}/src", "1", [{"item": f"i{i}", "annotator": f"p{a}", "label": "R"} for i in range(50) for a in (1, 2)])
    q = A.stream_dedup(log(spark, f"{path}/src", n, 3), f"{path}/first", f"{path}/c1")
    q.awaitTermination()
    assert [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]] == [100]
    new = spark.read.option("basePath", f"{path}/first").parquet(*files(f"{path}/first")).collect()
    assert sorted((r.outcome, r.annotator) for r in new) == [("kept", "p2")] * 50 + [("repeated", "p1")] * 50
    A.run_to(A.stream_pairs(A.stream_kept(spark, f"{path}/first"), "A", 1), f"{path}/pairs", f"{path}/c2")
    pairs = spark.read.parquet(*files(f"{path}/pairs")).collect()
    assert sorted((r.item, r.a, r.b, r.same, r.pa, r.pb) for r in pairs) == sorted((f"i{i}", f"p{a}", "p2", 0, 1, 0) for i in range(50) for a in (0, 1))


class Held(dict):
    """A map state that counts its calls."""

    calls = 0

    def exists(self):
        self.calls += 1
        return bool(self)

    def containsKey(self, key):
        self.calls += 1
        return key in self

    def getValue(self, key):
        self.calls += 1
        return self[key]

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value


def test_submissions_ask_the_state_by_buckets():
    """Batches of many and of few keys against a set: calls to the state are a small share of the keys, and few read little of it."""
    p, rng, known = A.FirstSubmission(), random.Random(4), set()
    p.seen = Held()
    for n in (20_000, 3, 30_000, 5000, 1):
        keys = [(f"p{rng.randrange(3000)}", "echo", f'i"{rng.randrange(12)},') for _ in range(n)]
        rows = pd.DataFrame(keys, columns=["annotator", "category", "item"]).assign(label="A", response_time=1.0, replay=0, submitted_at=pd.Timestamp("2024-01-01"), part_no=1)
        rows["key_text"] = [json.dumps(k) for k in keys]
        rows["replay"] = rng.sample(range(n), n)
        p.seen.calls = 0
        (out,) = p.handleInputRows((1,), iter([rows.iloc[: n // 2], rows.iloc[n // 2 :]]), None)
        assert p.seen.calls <= (5 * n + 3 if n < 10 else n / 8)
        want = rows[~rows["key_text"].isin(known)].sort_values("replay").drop_duplicates("key_text")
        assert sorted(out["replay"][out["outcome"] == "kept"]) == sorted(want["replay"]) and len(out) == n and list(out.columns) == [*rows.columns.drop(["part_no", "key_text"]), "outcome"]
        known |= set(rows["key_text"])
    stored = [json.loads(v[0]) for k, v in p.seen.items() if k != (-1,)]
    assert sorted(k for b in stored for k in b) == sorted(known) and max(map(len, stored)) < 5 * A.FILL


def test_pairs_of_many_items_in_few_calls(monkeypatch):
    """Batches of labels in two slices against all pairs, made in small pieces; calls to the state are a small share of the labels."""
    monkeypatch.setattr(A, "PAIR_ROWS", 50)
    parts, rng, labels, pairs, calls = [A.PairLabels(), A.PairLabels()], random.Random(6), {}, [], 0
    for p in parts:
        p.labels = Held()
    for n in (3000, 40, 2000):
        new = {(f"i:{int(rng.random() ** 3 * 400)}", f"p{rng.randrange(60)}"): rng.randrange(2) for _ in range(n)}
        new = {k: v for k, v in new.items() if k not in labels}
        for at, p in enumerate(parts):
            rows = pd.DataFrame([(who, said, hash(who) % 2 == at, f"{at}:{item}", 1) for (item, who), said in new.items()], columns=["annotator", "positive", "own", "key_text", "part_no"])
            for out in p.handleInputRows((1,), iter([rows]), None):
                pairs += out[["item", "a", "b", "same", "pa", "pb"]].itertuples(index=False, name=None)
        labels |= new
        want = [(i, a, b, int(x == y), x, y) for (i, a), x in labels.items() for (j, b), y in labels.items() if i == j and a < b] if n == 2000 else []
    assert sorted(pairs) == sorted(want) and len(want) > 10_000
    assert sum(p.labels.calls for p in parts) < len(labels) / 20
