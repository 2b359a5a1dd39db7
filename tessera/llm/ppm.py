"""Language-model scoring by partial matching: a byte-context trie with escapes and symbol exclusion.

The trie holds counts of bytes after contexts of up to five bytes, over all training texts, and grows with them: it is a
written table of every context and symbol (a gram) with its count, and no context is dropped for being rare. Workers hold
the probabilities of the commonest grams; those of all others are worked out where the table's rows with the same three
last context bytes meet, and joined with the texts' grams. One scan counts, one scores.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ARROW_ROWS, blocks, bucket, materialize

#: Share of all training bytes that a context needs to keep its node: every context keeps it.
NODE_SHARE = 0.0
#: Bytes of the longest contexts.
DEPTH = 5
#: Texts begin after three zero bytes and end with the symbol 255, which UTF-8 never has.
START, END = b"\0\0\0", b"\xff"
#: Words whose counts every worker holds; those of all others are joined.
HEAD_WORDS = 100_000
#: Grams whose probabilities every worker holds; those of all others are joined.
HEAD_GRAMS = 1_000_000
#: Longer words are counted under their digest.
LONG_WORD = 48
BLOCK = 1 << 20
#: Distinct words and grams that a task holds before it hands their counts on; Spark adds them up before the shuffle.
FLUSH, GRAMS_HELD = 150_000, 3 << 20
#: Grams that a task works on at once, if they do not all end alike.
CHUNK = 1 << 20


def word_keys(text: str | None) -> list[bytes]:
    """Words between ASCII white space with A-Z lower-cased; long ones as 255 and their digest."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if text and any(len(w) > LONG_WORD for w in words):
        words = [w if len(w) <= LONG_WORD else b"\xff" + hashlib.sha256(w).digest() for w in words]
    return words


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The four bytes up to and with every symbol of all texts, as numbers, and where each text's begin."""
    raws = [START + (t.encode("utf-8", "surrogatepass") if t else b"") + END for t in texts]
    data = np.frombuffer(b"".join(raws), np.uint8).astype(np.uint32)
    key = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    lens = np.array([len(r) for r in raws])
    ends = np.cumsum(lens)[:-1]
    real = np.ones(len(key), bool)
    for k in range(-3, 0):  # grams that reach into the next text's start
        real[ends + k] = False
    return key[real], np.concatenate([[0], np.cumsum(lens - 3)[:-1]])


def windows(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Every symbol after its context of up to five bytes, as a number, and where each text's begin.

    A text's first symbol has only three bytes before it and its second four: they bear 2 and 1 above the 48 bits.
    """
    four, starts = grams(texts)
    key = four.astype(np.int64)
    key[1:] |= (four[:-1] >> 24).astype(np.int64) << 32
    key[2:] |= (four[:-2] >> 24).astype(np.int64) << 40
    second = starts[np.diff(np.append(starts, len(four))) > 1] + 1
    key[starts] = (key[starts] & 0xFFFFFFFF) | 2 << 48
    key[second] = (key[second] & 0xFFFFFFFFFF) | 1 << 48
    return key, starts


def _added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their n."""
    kinds, which = np.unique(keys, return_inverse=True)
    return kinds, np.bincount(which, n, len(kinds)).astype(np.int64)


def _counted(batches):
    """(word or null, gram or null, n) of the training texts; the end of a text is the empty word."""
    words: Counter = Counter()
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def add_up():
        held[:] = [_added(*(np.concatenate(x) for x in zip(*held, strict=True)))]
        return len(held[0][0])

    def flush_grams():
        keys, n = held.pop()
        return pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.binary()), pa.array(keys), pa.array(n)], names=["word", "gram", "n"])

    def flush_words():
        out = pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.nulls(len(words), pa.int64()), pa.array(list(words.values()), pa.int64())], names=["word", "gram", "n"])
        words.clear()
        return out

    for block in blocks(batches, "text", BLOCK):
        texts = block.column("text").to_pylist()
        for t in texts:
            words.update(word_keys(t))
        words[b""] += len(texts)
        held.append(np.unique(windows(texts)[0], return_counts=True))
        size += len(held[-1][0])
        if size > GRAMS_HELD:
            size = add_up()
            if size > GRAMS_HELD // 2:
                yield flush_grams()
                size = 0
        if len(words) > FLUSH:
            yield flush_words()
    if held:
        add_up()
        yield flush_grams()
    if words:
        yield flush_words()


class Depth:
    """Counts of the symbols after all contexts of one length, and what an escape to the shorter context leaves there."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, bytes_: int, shorter: Depth | None):
        self.keys, self.n = keys, n
        self.contexts, which = np.unique(keys >> 8, return_inverse=True)
        sums = lambda x: np.bincount(which, x, len(self.contexts))
        self.total, self.kinds = sums(n), sums(n > 0)
        #: How often the symbols seen after a context are seen after the shorter one.
        self.shut = sums(np.where(n > 0, shorter.count(keys & ((1 << 8 * bytes_) - 1)), 0)) if shorter else np.zeros(len(self.contexts))

    def count(self, keys: np.ndarray) -> np.ndarray:
        return _found(self.keys, self.n, keys)


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The value of each wanted key, 0 without one."""
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def _depths(keys: np.ndarray, n: np.ndarray, lengths: range, below: list[Depth]) -> list[Depth]:
    """Those of `below` and of `lengths`, shortest first; grams that bear a mark have no contexts longer than it says."""
    out = list(below)
    for d in lengths:
        long = keys >> 48 <= 5 - d
        out.append(Depth(*_added(keys[long] & ((1 << 8 * (d + 1)) - 1), n[long]), d, out[-1] if out else None))
    return out


def log_probabilities(keys: np.ndarray, depths: list[Depth]) -> np.ndarray:
    """log10 of each gram's symbol after its context: down the contexts, a byte that a longer one has seen not counted."""
    p, mass = np.zeros(len(keys)), np.ones(len(keys))
    shut, shut_kinds = np.zeros(len(keys)), np.zeros(len(keys))
    for d in range(DEPTH, -1, -1):
        gram, level = keys & ((1 << 8 * (d + 1)) - 1), depths[d]
        live = keys >> 48 <= 5 - d
        context = gram >> 8
        all_kinds = _found(level.contexts, level.kinds, context)
        kinds = all_kinds - shut_kinds
        whole = _found(level.contexts, level.total, context) - shut + kinds
        some = live & (p == 0) & (kinds > 0)
        n, over = level.count(gram), np.where(some, whole, 1)
        p = np.where(some & (n > 0), mass * n / over, p)
        mass = np.where(some, mass * kinds / over, mass)
        shut = np.where(live, _found(level.contexts, level.shut, context), 0)
        shut_kinds = np.where(live, all_kinds, 0)
    return np.log10(np.where(p > 0, p, mass / np.maximum(256 - shut_kinds, 1)))


#: Contexts of one depth, ascending (as numbers, the last byte lowest), and the counts of the 256 bytes after each.
Level = tuple[np.ndarray, np.ndarray]


class Trie:
    """The same in memory, for small tables and tests: nodes of all contexts, and log probabilities of each byte after them."""

    def __init__(self, levels: list[Level], scored: bool = True):
        sizes = [len(c) for c, _ in levels]
        self.base = np.cumsum([0, *sizes])
        self.levels = levels
        inner = np.zeros(self.base[-1], np.int32)
        rows = [np.full((1, 256), -1, np.int32)]
        used = 1
        for d in range(1, len(levels)):
            contexts = levels[d][0]
            parents = self._at(d - 1, contexts & ((1 << 8 * (d - 1)) - 1)) + self.base[d - 1]
            kinds, which = np.unique(parents, return_inverse=True)
            own = np.full((len(kinds), 256), -1, np.int32)
            own[which, contexts >> 8 * (d - 1)] = np.arange(len(contexts)) + self.base[d]
            inner[kinds] = np.arange(used, used + len(kinds))
            used += len(kinds)
            rows.append(own)
        self.inner, self.child = inner, np.concatenate(rows)
        if scored:
            self.logs = np.concatenate([self._logs(d, i, i + 2048) for d in range(len(levels)) for i in range(0, sizes[d], 2048)])
        self.levels = None

    def _at(self, d: int, contexts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.levels[d][0], contexts)

    def _logs(self, depth: int, start: int, stop: int) -> np.ndarray:
        contexts = self.levels[depth][0][start:stop]
        n = len(contexts)
        p, mass, shut = np.zeros((n, 256)), np.ones(n), np.zeros((n, 256), bool)
        for d in range(depth, -1, -1):
            c = self.levels[d][1][self._at(d, contexts & ((1 << 8 * d) - 1))].astype(float)
            c[shut] = 0  # a byte that a longer context has seen was not what escaped from it
            total, kinds = c.sum(axis=1), (c > 0).sum(axis=1)
            seen = total > 0
            whole = np.where(seen, total + kinds, 1)
            p += (mass / whole)[:, None] * c
            mass = np.where(seen, mass * kinds / whole, mass)
            shut |= c > 0
        rest = (~shut).sum(axis=1)
        p += np.where(shut, 0, (mass / np.maximum(rest, 1))[:, None])
        return np.log10(np.maximum(p, 1e-300)).astype(np.float32)

    def nodes(self, key: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The node of the longest kept context before every symbol."""
        node = np.zeros(len(key), np.int32)
        live = np.ones(len(key), bool)
        before = np.zeros(len(key), np.uint32)
        before[1:] = key[:-1]
        for d in range(DEPTH):
            byte = (key >> 8 * (d + 1)) & 0xFF if d < 3 else (before >> 8 * d) & 0xFF if d == 3 else None
            if d == 4:
                byte = np.zeros(len(key), np.uint32)
                byte[2:] = key[:-2] >> 24
            if d >= 3:
                for k in range(d - 2):  # too near a text's begin for contexts of that length
                    live[np.minimum(starts + k, len(key) - 1)] = False
            to = self.child[self.inner[node], byte]
            live &= to >= 0
            np.copyto(node, to, where=live)
        return node

    def score(self, texts: list[str | None]) -> np.ndarray:
        """log10 probability of each text and its end."""
        key, starts = grams(texts)
        logs = self.logs.ravel()[(self.nodes(key, starts).astype(np.int64) << 8) + (key & 0xFF)]
        return np.add.reduceat(logs.astype(np.float64), starts)


def brute_log10(counts: list[dict[int, np.ndarray]], context: bytes, symbol: int) -> float:
    """The same probability by stepping down the contexts one at a time, for tests."""
    own = 0
    while own < min(DEPTH, len(context)) and int.from_bytes(context[-own - 1 :], "big") in counts[own + 1]:
        own += 1
    mass, shut = 1.0, set()
    for d in range(own, -1, -1):
        c = counts[d].get(int.from_bytes(context[len(context) - d :], "big"))
        open_ = {s: int(n) for s, n in enumerate(c) if n and s not in shut} if c is not None else {}
        if not open_:
            continue
        whole = sum(open_.values()) + len(open_)
        if symbol in open_:
            return log10(mass * open_[symbol] / whole)
        mass *= len(open_) / whole
        shut |= set(open_)
    return log10(mass / (256 - len(shut)))


def gather(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts over all of `docs`: of every word, of the ends of texts (the empty word) and of every gram."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    source = docs.select(F.col(text).cast("string").alias("text"))
    counted = source.mapInArrow(_counted, "word binary, gram long, n long")
    return materialize(counted.groupBy("word", "gram").agg(F.sum("n").alias("n")))


def short_contexts(table: DataFrame) -> list[Depth]:
    """Of contexts up to two bytes: at most 2^24 grams of three bytes reach the driver."""
    t = table.groupBy((F.col("gram") % (1 << 24)).alias("gram")).agg(F.sum("n").alias("n")).toArrow()
    return _depths(t.column("gram").to_numpy(), t.column("n").to_numpy(), range(3), [])


def probabilities(table: DataFrame, below) -> DataFrame:
    """(gram, log) of the rows of (gram, n, asked) that are asked for; n of equal grams adds up, and may be 0.

    All grams with the same three last context bytes, at most 2^24 + 2^16 + 2^8 distinct ones, meet in one task; it works on
    CHUNK of them or one such group at a time.
    """

    def work(held):
        keys, n, asked = (np.concatenate(x) for x in zip(*held, strict=True))
        depths = _depths(keys, n, range(3, DEPTH + 1), below.value)
        keys = np.unique(keys[asked])
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(log_probabilities(keys, depths))], names=["gram", "log"])

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []
        size, due = 0, CHUNK
        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("gram", "n", "asked")))
            size += batch.num_rows
            if size < due:
                continue
            held = [tuple(np.concatenate(x) for x in zip(*held, strict=True))]
            last = held[0][0] >> 8 & 0xFFFFFF
            cut = int(np.argmax(last == last[-1]))
            if cut:
                yield work([tuple(x[:cut] for x in held[0])])
                held, size = [tuple(x[cut:] for x in held[0])], size - cut
            due = size + CHUNK
        if size:
            yield work(held)

    end = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFFFF)).alias("__end")
    dealt = table.select("gram", "n", "asked", end).repartition("__end").sortWithinPartitions("__end")
    return dealt.mapInArrow(run, "gram long, log double")


def _common(counts: DataFrame, size: int):
    """The condition of the commonest rows, at most `size`: above a count that a histogram by quarter powers of two gives."""
    step = F.floor(F.log2("n") * 4)
    bins = counts.groupBy(step.alias("b")).agg(F.count("*").alias("k")).orderBy(F.desc("b")).collect()
    held, least = 0, None
    for r in bins:
        if held + r.k > size:
            break
        held, least = held + r.k, r.b
    return F.lit(False) if least is None else step >= least


def _head(words: DataFrame, size: int) -> dict[bytes, int]:
    return {bytes(r.word): r.n for r in words.filter(_common(words, size)).collect()}


def _head_grams(table: DataFrame, size: int, below) -> tuple[np.ndarray, np.ndarray]:
    """The commonest grams, ascending, and their log probabilities."""
    t = probabilities(table.select("gram", "n", _common(table, size).alias("asked")), below).toArrow()
    keys, logs = t.column("gram").to_numpy(), t.column("log").to_numpy().astype(np.float32)
    order = np.argsort(keys)
    return keys[order], logs[order]


def head_score(texts: list[str | None], keys: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """Of each text the sum of its held grams' log probabilities, and the other grams with how often they occur."""
    key, starts = windows(texts)
    kinds, which = np.unique(key, return_inverse=True)
    at = np.minimum(np.searchsorted(keys, kinds), max(len(keys) - 1, 0))
    held = keys[at] == kinds if len(keys) else np.zeros(len(kinds), bool)
    own = np.where(held, logs[at], 0).astype(np.float64) if len(keys) else np.zeros(len(kinds))
    left = np.flatnonzero(~held[which])
    row = np.searchsorted(starts, left, "right") - 1
    pairs, k = np.unique(row << 32 | which[left], return_counts=True)
    offsets = np.searchsorted(pairs >> 32, np.arange(len(texts) + 1)).astype(np.int32)
    rare = pa.StructArray.from_arrays([pa.array(kinds[pairs & 0xFFFFFFFF]), pa.array(k.astype(np.int64))], names=["gram", "k"])
    return np.add.reduceat(own[which], starts), pa.ListArray.from_arrays(pa.array(offsets), rare)


SCORED = "rid long, n_tokens long, head_known long, head_base double, head_score double, tail array<struct<word:binary,k:int>>, rare array<struct<gram:long,k:long>>"


def score(docs: DataFrame, train: DataFrame, keep=("doc_id",), text: str = "text", head_words: int = HEAD_WORDS, head_grams: int = HEAD_GRAMS) -> DataFrame:
    """Per row of `docs`: n_tokens, n_known, train_tokens, base_score and score, learned from the texts of `train`.

    Tokens: words between ASCII white space with A-Z lower-cased, then one end. base_score: sum of log10((c + 1) / (N + V + 1)).
    score: log10 probability that the trie gives the bytes of the text and its end. Null counts as empty. Repeated rows
    stay, each with its own result; other columns than `keep` and the text are not read. Without training texts every
    byte is as likely as any other. Two scans of the texts; the words and grams that few texts have are joined with their counts and
    probabilities, so no worker holds a table that grows with the corpus, and no key of those joins is frequent in `train`.
    """
    spark = docs.sparkSession
    counts = gather(train, text)
    words = counts.filter("word is not null").select("word", "n")
    n_all, n_kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    whole = n_all + n_kinds + 1
    table = counts.filter("word is null").select("gram", "n")
    below = spark.sparkContext.broadcast(short_contexts(table))
    shared = spark.sparkContext.broadcast((*_head_grams(table, head_grams, below), {w: log10((n + 1) / whole) for w, n in _head(words, head_words).items()}))
    kept = [k for k in dict.fromkeys(keep) if k not in ("n_tokens", "n_known", "train_tokens", "base_score", "score")]
    source = docs.select(*[F.col(k) for k in kept], F.col(text).cast("string").alias("__text"))
    schema = spark.createDataFrame([], SCORED).schema
    out_schema = type(schema)([source.schema[k] for k in kept] + list(schema.fields))

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out_schema)
        keys, logs, head = shared.value
        get, rid = head.get, TaskContext.get().partitionId() << 40
        for block in blocks(batches, "__text", BLOCK):
            texts = block.column("__text").to_pylist()
            rows: dict[str, list] = {f.name: [] for f in schema}
            for t in texts:
                tokens = word_keys(t)
                tokens.append(b"")
                values = list(map(get, tokens))
                tail = Counter([w for w, v in zip(tokens, values, strict=True) if v is None]) if None in values else {}
                rows["n_tokens"].append(len(tokens))
                rows["head_known"].append(len(tokens) - sum(tail.values()))
                rows["head_base"].append(sum([v for v in values if v is not None]) if tail else sum(values))
                rows["tail"].append([{"word": w, "k": k} for w, k in tail.items()])
            rows["rid"] = list(range(rid, rid + len(texts)))
            rid += len(texts)
            rows["head_score"], rare = head_score(texts, keys, logs)
            columns = [block.column(k).cast(arrow.field(k).type) for k in kept]
            columns += [pa.array(rows[f.name], type=arrow.field(f.name).type) for f in schema if f.name != "rare"]
            columns.append(rare.cast(arrow.field("rare").type))
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    scored = materialize(source.mapInArrow(run, out_schema))
    tail = scored.select("rid", F.explode("tail").alias("t")).select("rid", "t.word", "t.k").join(words, "word", "left")
    c = F.coalesce(F.col("n"), F.lit(0))
    rest = tail.groupBy("rid").agg(
        F.sum(F.col("k") * F.log10((c + 1) / F.lit(float(whole)))).alias("tail_base"), F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("tail_known")
    )
    rare = scored.select("rid", F.explode("rare").alias("g")).select("rid", "g.gram", "g.k")
    asked = rare.select("gram").distinct().select("gram", F.lit(0).cast("long").alias("n"), F.lit(True).alias("asked"))
    found = probabilities(table.withColumn("asked", F.lit(False)).union(asked), below)
    deep = rare.join(found, "gram").groupBy("rid").agg(F.sum(F.col("k") * F.col("log")).alias("rare_score"))
    return scored.drop("tail", "rare").join(rest, "rid", "left").join(deep, "rid", "left").select(
        *kept, "n_tokens", (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.coalesce("tail_base", F.lit(0.0))).alias("base_score"),
        (F.col("head_score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
    )


def held_out_score(docs: DataFrame) -> DataFrame:
    """All documents scored by what those outside a held-out seventh teach; held_out marks that seventh."""
    held = bucket("doc_id", 7) == 2
    return score(docs, docs.filter(~held)).withColumn("held_out", held)
