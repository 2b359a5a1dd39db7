"""Passages that repeat across documents, by a sparse suffix array.

Suffixes are retained where a minimiser of ten words stands, at least one in any 25 words. They are sorted by a digest of
their first 35 words, and neighbours that agree mark a repeated stretch; stretches of a document that overlap form runs. A
passage of fifty words or more contains such a suffix within its first sixteen words, so none is missed.

Runs are not extended pair by pair: how far a place goes on to the left and to the right with another document depends on
which one, the neighbour in suffix order need not be the one with which both together reach fifty words, and trying all of a
group's pairs grows with its square. Instead every fifty words in and around a run are sorted and compared with their
neighbours in the same way, which says for each place whether any document shares it. The result is exact but for collisions of
64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ARROW_ROWS, blocks, materialize, words_of
from .near import word_hashes

MIN_WORDS = 50
#: Words of a minimiser, and how many of them one is chosen from.
GRAM, WINDOW = 10, 16
#: Columns of a place; anon: the digest of a text without id.
PLACE = ["key", "doc_id", "anon", "pos"]
#: Words before the first minimiser of a passage, at most, and words that sort a suffix.
SLACK = WINDOW - 1
PREFIX = MIN_WORDS - SLACK
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MUL = np.uint64(0xBF58476D1CE4E5B9)


class Hashes:
    """Hashes of any stretch of words of a block of documents, from prefix sums."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE, np.uint64)]))
        self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, INVERSE, np.uint64)]))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(words * power[:n])])

    def of(self, start: np.ndarray, size: int) -> np.ndarray:
        h = (self.sums[start + size] - self.sums[start]) * self.back[start]
        h = (h ^ (h >> np.uint64(30))) * MUL
        return h ^ (h >> np.uint64(27))


def retained(h: Hashes, lens: np.ndarray) -> np.ndarray:
    """Positions of the retained suffixes that have PREFIX words left in their document."""
    n = int(lens.sum())
    if n < GRAM + WINDOW:
        return np.zeros(0, np.int64)
    grams = h.of(np.arange(n - GRAM + 1), GRAM)
    views = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)
    ends = np.repeat(np.cumsum(lens), lens)
    whole = np.flatnonzero(np.arange(len(views)) + WINDOW + GRAM - 1 <= ends[: len(views)])
    chosen = np.concatenate([part + views[part].argmin(axis=1) for part in np.array_split(whole, max(1, len(whole) >> 18))])
    chosen = np.unique(chosen)
    return chosen[chosen + PREFIX <= ends[chosen]]


def _suffixes(batches):
    for block in blocks(batches, "text"):
        docs = [words_of(t) for t in block.column("text").to_pylist()]
        docs = [d if len(d) >= MIN_WORDS else [] for d in docs]
        words, lens = word_hashes(docs)
        h = Hashes(words)
        at = retained(h, lens)
        owner = np.searchsorted(np.cumsum(lens), at, side="right")
        pos = at - (np.cumsum(lens) - lens)[owner]
        yield pa.RecordBatch.from_arrays(
            [pa.array(h.of(at, PREFIX).view(np.int64)), *(block.column(c).take(pa.array(owner)) for c in ("doc_id", "anon")), pa.array(pos.astype(np.int32))],
            names=PLACE,
        )


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    """Ids to compare; rows without id are told apart by the digest of their text."""
    ids, anon = batch.column("doc_id"), batch.column("anon")
    if pa.types.is_integer(ids.type):
        return pc.coalesce(ids.cast(pa.int64()), anon).to_numpy(zero_copy_only=False)
    return pc.coalesce(ids.cast(pa.string()), anon.cast(pa.string())).to_numpy(zero_copy_only=False)


def _neighbours(batches):
    """Rows of a sorted partition whose suffix another document has too.

    Suffixes that agree stand side by side, those of one document together, so a group is shared if its first and last
    documents differ; of a group that has shown one document so far only that document's rows are held. The first and the
    last group of a partition may go on in the next one: their rows are marked as edges, and not sure while unshared.
    """
    held = None
    known_key, known_shared, first = None, False, True

    def rows(batch, keep, sure, edge):
        at = pa.array(np.flatnonzero(keep))
        return pa.RecordBatch.from_arrays(
            [batch.column(c).take(at) for c in PLACE] + [pa.array(sure[keep]), pa.array(edge[keep])], names=[*PLACE, "sure", "edge"]
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        key, ids = batch.column("key").to_numpy(), _ids(batch)
        starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        stops = np.append(starts[1:], len(key))
        shared = ids[starts] != ids[stops - 1]
        if known_shared and key[0] == known_key:
            shared[0] = True
        edges = np.zeros(len(starts), bool)
        edges[0] = first
        if known_shared and key[0] == known_key and not first:
            edges[0] = edge_open
        keep, edge = np.repeat(shared | edges, stops - starts), np.repeat(edges, stops - starts)
        sure = np.repeat(shared, stops - starts)
        first_group_only = len(starts) == 1
        known_key, known_shared = key[-1], bool(shared[-1])
        edge_open = bool(edges[-1])
        if known_shared:
            held = None
            first = False
            edge[starts[-1] :] = True  # it may be the partition's last group
        else:
            held = batch.slice(int(starts[-1]))
            keep[starts[-1] :] = False
            first = first and first_group_only
        if keep.any():
            yield rows(batch, keep, sure, edge)
    if held is not None:
        n = held.num_rows
        yield rows(held, np.ones(n, bool), np.zeros(n, bool), np.ones(n, bool))


def _merge(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _around(batches):
    """The fifty words at every place in a run and around it."""
    for block in blocks(batches, "text"):
        docs = [words_of(t) for t in block.column("text").to_pylist()]
        words, lens = word_hashes(docs)
        h, begin = Hashes(words), np.cumsum(lens) - lens
        owners, places = [], []
        for i, positions in enumerate(block.column("positions").to_pylist()):
            last = int(lens[i]) - MIN_WORDS
            for a, b in _merge([(p, p + PREFIX) for p in positions]):
                at = np.arange(min(a, b - MIN_WORDS) - SLACK, max(a, b - MIN_WORDS) + SLACK + 1)
                at = np.unique(at[(at >= 0) & (at <= last)])
                owners.append(np.full(len(at), i))
                places.append(at)
        owner = np.concatenate([*owners, np.zeros(0, np.int64)]).astype(np.int64)
        pos = np.concatenate([*places, np.zeros(0, np.int64)]).astype(np.int64)
        key = h.of(pos + begin[owner], MIN_WORDS).view(np.int64) if len(pos) else np.zeros(0, np.int64)
        named = [block.column(c).take(pa.array(owner)) for c in ("doc_id", "anon")]
        yield pa.RecordBatch.from_arrays([pa.array(key), *named, pa.array(pos.astype(np.int32))], names=PLACE)


def _spans(batches):
    """Unions of the fifty words at the places of each document that another has as well."""
    for batch in batches:
        owners, starts, ends = [], [], []
        for i, places in enumerate(batch.column("places").to_pylist()):
            for a, b in _merge([(p, p + MIN_WORDS) for p in places]):
                owners.append(i)
                starts.append(a)
                ends.append(b)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owners, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["doc_id", "start_word", "end_word"])


def shared(rows: DataFrame) -> DataFrame:
    """Of (key, doc_id, pos) those whose key another document has too: sorted, and neighbours compared.

    Dealt by ranges of key and document, so a key that very many documents have is split among tasks.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    order = rows.repartitionByRange("key", "doc_id", "anon").sortWithinPartitions("key", "doc_id", "anon", "pos")
    marked = materialize(order.mapInArrow(_neighbours, f"key long, doc_id {kind}, anon long, pos int, sure boolean, edge boolean"))
    ids = F.coalesce(F.col("doc_id").cast("string"), F.col("anon").cast("string"))
    across = marked.filter("edge").groupBy("key").agg(F.min(ids).alias("lo"), F.max(ids).alias("hi")).filter("lo <> hi").select("key")
    return marked.filter("sure").union(marked.filter("not sure").join(across, "key", "left_semi").select(*marked.columns)).select("doc_id", "anon", "pos")


def repeated_passages(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, start_word, end_word, n_words): stretches of MIN_WORDS words or more that another document has as well.

    Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` with A-Z lower-cased, counted from 0, end excluded. Where several repeated
    stretches overlap or touch, their union is one row; different documents may share its parts. Documents are told
    apart by doc_id: rows that share an id count as one document; rows without id by their text, and what they share is
    returned without id. Null, empty and shorter texts have no passages; repeats within one document alone are none. Other columns are not read.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    whole = F.col(text).cast("string")
    source = docs.select("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64(whole)).alias("anon"), whole.alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    place = f"key long, doc_id {kind}, anon long, pos int"
    suffixes = materialize(source.mapInArrow(_suffixes, place))
    runs = shared(suffixes).groupBy("doc_id", "anon").agg(F.collect_set("pos").alias("positions"))
    runs = materialize(runs.withColumnsRenamed({"doc_id": "run_id", "anon": "run_anon"}))
    same = F.col("doc_id").eqNullSafe(F.col("run_id")) & F.col("anon").eqNullSafe(F.col("run_anon"))
    held = source.join(runs, same).select("doc_id", "anon", "text", "positions")
    around = materialize(held.mapInArrow(_around, place))
    places = shared(around).groupBy("doc_id", "anon").agg(F.collect_set("pos").alias("places"))
    spans = places.mapInArrow(_spans, f"doc_id {kind}, start_word long, end_word long")
    return spans.withColumn("n_words", F.col("end_word") - F.col("start_word"))


def brute(rows: list[tuple], size: int = MIN_WORDS) -> dict:
    """doc_id -> words covered by windows of `size` words that another document has, for tests."""
    seen: dict[tuple, set] = {}
    texts = [(i, words_of(t)) for i, t in rows]
    for i, w in texts:
        for k in range(len(w) - size + 1):
            seen.setdefault(tuple(w[k : k + size]), set()).add(i)
    out: dict = {}
    for i, w in texts:
        for k in range(len(w) - size + 1):
            if len(seen[tuple(w[k : k + size])]) > 1:
                out.setdefault(i, set()).update(range(k, k + size))
    return out
