"""The growing annotation log as a stream: validation, deduplication, running summaries and agreement."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from ..operators import labels as L
from ..operators.scoring import share

SUBMISSION = "annotator string, category string, item string, label string, response_time double, replay long, submitted_at timestamp"


def stream_submissions(spark: SparkSession, path: str, items: DataFrame, assignments: DataFrame, labels: tuple[str, str] = ("A", "R"), files: int | None = None) -> DataFrame:
    """New submissions with truth, is_correct and reject_reason (null where accepted).

    path: folder of JSON lines. items, static: item, truth. assignments, static: annotator, category. Checked in order:
    category not assigned, label outside the domain, negative time or replay, unknown item. files: how many a batch takes.
    """
    source = spark.readStream.schema(SUBMISSION)
    s = (source.option("maxFilesPerTrigger", files) if files else source).json(path)
    s = s.join(items.select("item", "truth"), "item", "left").join(assignments.select("annotator", "category", F.lit(True).alias("assigned")).distinct(), ["annotator", "category"], "left")
    reason = (
        F.when(F.col("assigned").isNull(), "not_assigned").when(~F.coalesce(F.col("label").isin(*labels), F.lit(False)), "bad_label")
        .when((F.col("response_time") < 0) | (F.col("replay") < 0), "negative").when(F.col("truth").isNull(), "unknown_item")
    )
    return s.withColumns({"reject_reason": reason, "is_correct": F.col("label") == F.col("truth")}).drop("assigned")


#: Groups that the keys of a state are dealt to. A checkpoint holds state by group, so the number stays as it is.
PARTS = 256
#: Entries of a bucket, the unit in which a part's state is read and written.
FILL = 128
#: Pairs that a task makes at once and hands on in a frame.
PAIR_ROWS = 200_000


def _keyed_state(spark: SparkSession) -> None:
    """State by keys needs a store that reads and writes single keys: a batch costs what it touches, whatever is held."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Buckets:
    """A part's entries, text -> what JSON can hold, in buckets of some FILL by linear hashing: one bucket splits for every FILL new entries.

    State: number of a bucket -> its entries, and at -1 how many buckets and entries there are. Every call to the state costs as
    much as hundreds of entries, so what a batch asks for is read and written by buckets, each once. A batch touches as many
    as it has keys and new entries, whatever is held.
    """

    STATE = ("buckets", "bucket int", "entries string")

    def __init__(self, state, coming: int) -> None:
        """coming: about how many entries the first batch brings, for which buckets are laid out at once."""
        self.state, self.held, self.changed = state, {}, set()
        self.buckets, self.entries = json.loads(state.getValue((-1,))[0]) if state.containsKey((-1,)) else (0, 0)
        if not self.buckets:
            self.buckets = max(1, -(-coming // FILL))
            self.held = {i: {} for i in range(self.buckets)}
            self.changed = set(self.held)

    def _at(self, key: str) -> int:
        top, whole = 1 << (self.buckets.bit_length() - 1), zlib.crc32(key.encode())
        low = whole & (2 * top - 1)
        return low if low < self.buckets else whole & (top - 1)

    def _bucket(self, i: int) -> dict:
        if i not in self.held:
            self.held[i] = json.loads(self.state.getValue((i,))[0])
        return self.held[i]

    def get(self, key: str):
        return self._bucket(self._at(key)).get(key)

    def add(self, key: str) -> bool:
        """Puts an entry without a value; whether it is new."""
        i = self._at(key)
        bucket = self._bucket(i)
        if key in bucket:
            return False
        bucket[key] = None
        self.entries += 1
        self.changed.add(i)
        return True

    def put(self, key: str, value) -> None:
        i = self._at(key)
        bucket = self._bucket(i)
        self.entries += key not in bucket
        bucket[key] = value
        self.changed.add(i)

    def save(self) -> None:
        while self.entries > FILL * self.buckets:
            i, new = self.buckets - (1 << (self.buckets.bit_length() - 1)), self.buckets
            bucket = self._bucket(i)
            self.buckets += 1
            self.held[new] = {k: bucket.pop(k) for k in [k for k in bucket if self._at(k) == new]}
            self.changed |= {i, new}
        for i in self.changed:
            self.state.updateValue((i,), (json.dumps(self.held[i], separators=(",", ":")),))
        if self.changed:
            self.state.updateValue((-1,), (json.dumps([self.buckets, self.entries]),))


class FirstSubmission(StatefulProcessor):
    """Tells the first submission of (annotator, category, item) from later ones. State of a part: those seen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState(*Buckets.STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        late = np.zeros(len(batch), bool)
        again = batch[batch["key_text"].duplicated(keep=False)].sort_values(["submitted_at", "label", "response_time", "replay"], na_position="last", kind="stable")
        late[again.index[again["key_text"].duplicated()]] = True
        first = np.flatnonzero(~late)
        seen = Buckets(self.seen, len(first))
        late[first] = [not seen.add(what) for what in batch["key_text"].to_numpy(object)[first].tolist()]
        seen.save()
        yield batch.drop(columns=["part_no", "key_text"]).assign(outcome=np.where(late, "repeated", "kept"))

    def close(self) -> None:
        pass


def stream_dedup(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Every submission once in Parquet at `path`, in folders by `outcome`: the first of each (annotator, category, item) as
    `kept`, all later ones as `repeated`.

    First by submitted_at within a batch (then label, time and replays), and by batch across batches. What has been seen is
    state, dealt to parts by a hash of all three and looked up by buckets of keys: no earlier output is read, and no item or
    annotator makes a part. A part's rows of one batch are held together. annotator, category and item are never null in accepted rows.
    """
    _keyed_state(df.sparkSession)
    dealt = df.withColumns({"part_no": F.pmod(F.xxhash64("annotator", "category", "item"), F.lit(PARTS)), "key_text": F.to_json(F.array("annotator", "category", "item"))})
    told = dealt.groupBy("part_no").transformWithStateInPandas(FirstSubmission(), StructType([*df.schema.fields, StructField("outcome", StringType())]), "Append", "None")
    return told.writeStream.format("parquet").partitionBy("outcome").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_kept(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """What stream_dedup() has kept at `path`, as a stream: every row once, as the files that its log names."""
    source = spark.readStream.schema(f"{SUBMISSION}, truth string, reject_reason string, is_correct boolean, outcome string")
    return (source.option("maxFilesPerTrigger", files) if files else source).parquet(path).filter("outcome = 'kept'").drop("outcome")


def stream_summary(df: DataFrame) -> DataFrame:
    """Running totals, accuracy, mean time and replays per category and annotator; for complete or update mode."""
    return df.groupBy("category", "annotator").agg(F.count("*").alias("n_rows"), share(F.col("is_correct")).alias("accuracy"), F.avg("response_time").alias("mean_time"), F.avg("replay").alias("mean_replay"))


def stream_agreement(kept: DataFrame, labels: tuple[str, str] = ("A", "R")) -> DataFrame:
    """Consensus of the items that a batch touches, for update mode: n_labels, majority (ties by name), agreement of pairs.

    kept: one row for each annotator and item. Counts of the two labels are all the state, and are combined before the shuffle.
    """
    low, high = sorted(labels)
    c = kept.filter(F.col("label").isin(low, high)).groupBy("item").agg(L.n_if(F.col("label") == low).alias("x"), L.n_if(F.col("label") == high).alias("y"))
    n, same = F.col("x") + F.col("y"), F.col("x") * (F.col("x") - 1) + F.col("y") * (F.col("y") - 1)
    agreement = F.when(n == 1, 1.0).otherwise(F.try_divide(same.cast("double"), n * (n - 1)))
    return c.select("item", n.alias("n_labels"), F.when(F.col("x") >= F.col("y"), low).otherwise(high).alias("majority"), agreement.alias("agreement"))


class PairLabels(StatefulProcessor):
    """Pairs of every new label of an item with the labels of one slice of its annotators.

    State of a part: slice and item -> annotators and whether each said the positive label. All new labels of an item come to
    each of its slices, those of the slice marked as own. Two new ones pair where the greater annotator is at home.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.labels = handle.getMapState(*Buckets.STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        group, keys = pd.factorize(new["key_text"])
        items = np.array([k.partition(":")[2] for k in keys], object)
        labels = Buckets(self.labels, len(keys))
        known = [labels.get(k) or [[], []] for k in keys]
        n_old = np.array([len(k[0]) for k in known])
        # names as numbers in their order, of the labels held before and then of the new ones
        code, names = pd.factorize(np.array([*chain.from_iterable(k[0] for k in known), *new["annotator"]], object), sort=True)
        old, who = code[: n_old.sum()], code[n_old.sum() :]
        yes, own = new["positive"].to_numpy(np.int64), new["own"].to_numpy(bool)
        for g, name, said in zip(group[own].tolist(), new["annotator"][own], yes[own].tolist(), strict=True):
            known[g][0].append(name)
            known[g][1].append(said)
        for g in np.unique(group[own]).tolist():
            labels.put(keys[g], known[g])
        labels.save()
        # what is held of each group, group after group
        told = np.concatenate([np.repeat(np.arange(len(keys)), n_old), group[own]])
        order = np.argsort(told, kind="stable")
        held, is_old = np.concatenate([old, who[own]])[order], order < len(old)
        said = np.fromiter(chain.from_iterable(k[1] for k in known), np.int64, len(order))
        n = np.bincount(told, minlength=len(keys))
        first, size = (np.cumsum(n) - n)[group], n[group]
        upto = np.cumsum(size)
        at = 0
        while at < len(new):
            stop = max(at + 1, int(np.searchsorted(upto, upto[at] - size[at] + PAIR_ROWS, "right")))
            x = np.repeat(np.arange(at, stop), size[at:stop])
            y = np.arange(len(x)) - np.repeat(upto[at:stop] - size[at:stop] - (upto[at] - size[at]) - first[at:stop], size[at:stop])
            met = np.flatnonzero((is_old[y] | (held[y] > who[x])) & (held[y] != who[x]))
            x, y, at = x[met], y[met], stop
            after = held[y] > who[x]
            if len(x):
                yield pd.DataFrame({
                    "item": items[group[x]], "a": names[np.where(after, who[x], held[y])], "b": names[np.where(after, held[y], who[x])], "same": (said[y] == yes[x]).astype(np.int64),
                    "pa": np.where(after, yes[x], said[y]), "pb": np.where(after, said[y], yes[x]),
                })

    def close(self) -> None:
        pass


def stream_pairs(kept: DataFrame, positive: str, slices: int = 4) -> DataFrame:
    """(item, a, b, same, pa, pb) with a < b, once for every two annotators of an item, when the later of their labels comes.

    kept: one row for each annotator and item. A new label meets the labels of its item and nothing else. These lie in `slices`
    by annotator, to each of which new labels of the item go, so the pairs of a frequent item are made by as many tasks.
    """
    _keyed_state(kept.sparkSession)
    home = F.pmod(F.xxhash64("annotator"), F.lit(slices)).cast("int")
    told = kept.select("item", "annotator", F.coalesce(F.col("label") == positive, F.lit(False)).cast("int").alias("positive"), home.alias("__home"))
    told = told.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).withColumn("own", F.col("slice") == F.col("__home")).drop("__home")
    told = told.withColumns({"part_no": F.pmod(F.xxhash64("item", "slice"), F.lit(PARTS)), "key_text": F.concat_ws(":", F.col("slice").cast("string"), "item")}).drop("slice", "item")
    return told.groupBy("part_no").transformWithStateInPandas(PairLabels(), "item string, a string, b string, same long, pa long, pb long", "Append", "None")


def stream_pair_agreement(pairs: DataFrame) -> DataFrame:
    """Agreement and kappa of the pairs of annotators that a batch touches, for update mode. pairs: rows of stream_pairs()."""
    return L.pair_scores(pairs.groupBy("a", "b").agg(F.count("*").alias("n_shared"), F.sum("same").alias("same"), F.sum("pa").alias("pa"), F.sum("pb").alias("pb")))


def run_to(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what there is and stop. In update mode every batch's changed rows stay under its number: see latest()."""
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    else:
        to = (lambda n: f"{path}/batch={n}") if mode == "update" else lambda n: path
        sink = df.writeStream.outputMode(mode).foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(to(n)))
        q = sink.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def latest(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of the rows that update batches wrote, with their number in `batch`, the last one of each key."""
    rest = [c for c in updates.columns if c not in keys and c != "batch"]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return last.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])
