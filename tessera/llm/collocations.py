"""Phrase collocations: n-grams counted in burstable tries, spilled as sorted runs, merged by prefix partition.

A task counts in one trie for each language. It begins as one hash container, keyed by the ids of up to three words. When that has
grown, first words of more than BURST entries burst out of it into subtrees, with a container for each of their second words. When
a task holds more than HELD entries, whole subtrees, largest first, leave as sorted runs. A run is cut by the prefix partition of
its phrases (their first two words; third words in some slices, so that no frequent pair makes one partition) and packed as a
compressed block, so Spark shuffles blocks, not phrases. A task of the other side merges the runs of one prefix partition at a time.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ARROW_ROWS, blocks, materialize, salted_join

#: A candidate occurs so often at least, and each language keeps so many.
LEAST, TOP = 10, 2000
#: A phrase is dropped for a longer one that holds it and has at least so many hundredths of its places.
COVERED = 50

#: Entries of a container before it bursts, and of all tries of a task before subtrees leave.
BURST, HELD = 4096, 1 << 20
#: Words with an id in a task; beyond, everything leaves and ids begin anew.
WORDS = 1 << 19
#: Bits of a word's id in a key of three. 0 stands for no word.
BITS = 21
MASK = (1 << BITS) - 1
#: Bytes of text taken at once: with one byte and a blank to a word, their ids still fit.
CHUNK = 2 << 20
#: Prefix partitions for each task of a shuffle, and slices of third words.
UNITS, SLICES = 4, 16
#: Entries that wait to be merged; beyond, those of the same phrase are added up.
WAITING = 1 << 21
#: Parts of a language in which its best phrases are found first.
PARTS = 64

#: A-Z to lower case, tab to blank, each of `.,;:!?` and the line ends to a line feed.
PIECES = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_END = re.compile(rb"[ \n]")
#: The end of a piece as a word of its own: a byte that UTF-8 never has.
BREAK = b"\xff"


def chunks(text: str) -> Iterator[bytes]:
    """The text in bytes as PIECES maps them, cut at blanks into parts of about CHUNK; a longer word stays whole."""
    data = text.encode("utf-8", "surrogatepass").translate(PIECES)
    start = 0
    while len(data) - start > CHUNK:
        end = _END.search(data, start + CHUNK)
        if end is None:
            break
        yield data[start : end.start()] + (b"\n" if end[0] == b"\n" else b"")
        start = end.end()
    yield data[start:]


class Trie:
    """Counts of n-grams of one language by word ids: a container of whole keys, and subtrees of the first words that burst.

    subtrees: first word -> second word -> container of third words, 0 where there is none.
    """

    def __init__(self) -> None:
        self.root: dict[int, int] = {}
        self.subtrees: dict[int, dict[int, dict[int, int]]] = {}
        self.sizes: dict[int, int] = {}
        self.words = 0
        self.checked = BURST

    def __len__(self) -> int:
        return len(self.root) + sum(self.sizes.values())

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Keys of three ids, rising and distinct."""
        if self.subtrees:
            below = np.isin(keys >> 2 * BITS, np.fromiter(self.subtrees, np.int64, len(self.subtrees)))
            self._deep(keys[below], counts[below])
            keys, counts = keys[~below], counts[~below]
        root, get = self.root, self.root.get
        for key, n in zip(keys.tolist(), counts.tolist(), strict=True):
            root[key] = get(key, 0) + n
        if len(root) > 2 * self.checked:
            self._burst()
            self.checked = max(BURST, len(self.root))

    def _deep(self, keys: np.ndarray, counts: np.ndarray) -> None:
        pairs = keys >> BITS
        cuts = np.flatnonzero(np.diff(pairs, prepend=-1, append=-1))
        thirds, numbers = (keys & MASK).tolist(), counts.tolist()
        for pair, a, b in zip(pairs[cuts[:-1]].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            seconds = self.subtrees[pair >> BITS]
            held = seconds.get(pair & MASK)
            if held is None:
                seconds[pair & MASK] = dict(zip(thirds[a:b], numbers[a:b], strict=True))
                self.sizes[pair >> BITS] += b - a
                continue
            was, get = len(held), held.get
            for third, n in zip(thirds[a:b], numbers[a:b], strict=True):
                held[third] = get(third, 0) + n
            self.sizes[pair >> BITS] += len(held) - was

    def _burst(self) -> None:
        keys, counts = self._rooted()
        first, inverse, n = np.unique(keys >> 2 * BITS, return_inverse=True, return_counts=True)
        out = (n > BURST)[inverse]
        if not out.any():
            return
        for word in first[n > BURST].tolist():
            self.subtrees[word], self.sizes[word] = {}, 0
        self.root = dict(zip(keys[~out].tolist(), counts[~out].tolist(), strict=True))
        order = np.argsort(keys[out])
        self._deep(keys[out][order], counts[out][order])

    def _rooted(self) -> tuple[np.ndarray, np.ndarray]:
        return np.fromiter(self.root, np.int64, len(self.root)), np.fromiter(self.root.values(), np.int64, len(self.root))

    def parts(self) -> list[tuple[int, int]]:
        """(entries, first word) of every subtree; 0 stands for the container at the root."""
        return [(len(self.root), 0), *((n, w) for w, n in self.sizes.items())]

    def take(self, words: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Subtrees as keys and counts; they are gone from the trie."""
        keys, counts = [], []
        for word in words:
            if word == 0:
                found = self._rooted()
                self.root, self.checked = {}, BURST
                keys.append(found[0])
                counts.append(found[1])
                continue
            self.sizes.pop(word)
            for second, held in self.subtrees.pop(word).items():
                keys.append(np.fromiter(held, np.int64, len(held)) | (word << 2 * BITS | second << BITS))
                counts.append(np.fromiter(held.values(), np.int64, len(held)))
        return np.concatenate(keys), np.concatenate(counts)


class Ids(dict):
    """Word -> id, from 1 in the order of coming; the end of a piece is 0."""

    def __init__(self) -> None:
        super().__init__({BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Counter:
    """The tries of a task. feed() and close() return runs: (unit, lang, block)."""

    def __init__(self, units: int) -> None:
        self.units = units
        self.tries: dict[str, Trie] = {}
        self.ids = Ids()

    def feed(self, lang: str, texts: list[str | None]) -> Iterator[tuple[int, str, bytes]]:
        """Count the n-grams of whole texts, each by itself."""
        trie = self.tries.setdefault(lang, Trie())
        waiting, size = [], 0
        for text in texts:
            if not text:
                continue
            carried: list[int] = []
            for chunk in chunks(text):
                if size + len(chunk) > CHUNK and waiting:
                    yield from self._count(trie, waiting)
                    waiting, size = [], 0
                    if len(self.ids) > WORDS:
                        names = list(self.ids)
                        yield from self.close()
                        trie = self.tries.setdefault(lang, Trie())
                        carried = [self.ids[names[i]] for i in carried]
                # no blank or line end is left within a word, so split() finds exactly the words
                found = list(map(self.ids.__getitem__, chunk.replace(b"\n", b" \xff ").split()))
                waiting.append((carried, found))
                size += len(chunk) + 1
                carried = (carried + found)[-2:]
        if waiting:
            yield from self._count(trie, waiting)
        if len(self.ids) > WORDS:
            yield from self.close()

    def _count(self, trie: Trie, waiting: list[tuple[list[int], list[int]]]) -> Iterator[tuple[int, str, bytes]]:
        flat: list[int] = []
        new: list[bool] = []
        for carried, found in waiting:
            flat += [0, *carried, *found]
            new += [False] * (1 + len(carried)) + [True] * len(found)
        a = np.array([0, 0, *flat], np.int64)
        last, mid, far = a[2:], a[1:-1], a[:-2]
        fresh = np.array(new, bool) & (last > 0)
        two = fresh & (mid > 0)
        three = two & (far > 0)
        keys = np.concatenate([last[fresh] << 2 * BITS, mid[two] << 2 * BITS | last[two] << BITS, far[three] << 2 * BITS | mid[three] << BITS | last[three]])
        if len(keys):
            trie.words += int(fresh.sum())
            trie.add(*np.unique(keys, return_counts=True))
        if sum(map(len, self.tries.values())) > HELD:
            yield from self.spill(HELD // 2)

    def spill(self, keep: int) -> Iterator[tuple[int, str, bytes]]:
        """Let whole subtrees leave, the largest first, until at most `keep` entries stay."""
        held = sum(map(len, self.tries.values()))
        leaving: dict[str, list[int]] = {}
        for n, lang, word in sorted(((n, lang, w) for lang, t in self.tries.items() for n, w in t.parts() if n), key=lambda x: (-x[0], x[1], x[2])):
            if held <= keep:
                break
            leaving.setdefault(lang, []).append(word)
            held -= n
        words = pa.array(self.ids, pa.binary())
        hashes = np.fromiter(map(zlib.crc32, self.ids), np.uint64, len(self.ids))
        rank = np.empty(len(words), np.int64)
        rank[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
        rank[0] = -1
        for lang, chosen in leaving.items():
            yield from self._runs(lang, *self.tries[lang].take(chosen), words, hashes, rank + 1)

    def close(self) -> Iterator[tuple[int, str, bytes]]:
        """All that is left, and the number of words of each language as the count of the empty phrase; ids begin anew."""
        yield from self.spill(0)
        for lang, trie in self.tries.items():
            if trie.words:
                yield zlib.crc32(lang.encode()) % self.units, lang, packed(pa.array([b""], pa.binary()), np.array([trie.words]))
        self.tries, self.ids = {}, Ids()

    def _runs(self, lang: str, keys: np.ndarray, counts: np.ndarray, words: pa.Array, hashes: np.ndarray, rank: np.ndarray) -> Iterator[tuple[int, str, bytes]]:
        """A block for each prefix partition, its phrases in the order of their words."""
        ids = keys >> 2 * BITS, keys >> BITS & MASK, keys & MASK
        with np.errstate(over="ignore"):
            mixed = np.uint64(zlib.crc32(lang.encode()))
            for part in (hashes[ids[0]], hashes[ids[1]], hashes[ids[2]] % np.uint64(SLICES) * (ids[2] > 0).astype(np.uint64)):
                mixed = (mixed ^ part) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
        unit = (mixed % np.uint64(self.units)).astype(np.int64)
        order = np.argsort(rank[ids[0]] << 2 * BITS | rank[ids[1]] << BITS | rank[ids[2]])
        order = order[np.argsort(unit[order], kind="stable")]
        unit, counts, ids = unit[order], counts[order], [x[order] for x in ids]
        length = 1 + (ids[1] > 0) + (ids[2] > 0)
        made, place = [], np.empty(len(order), np.int64)
        for n in (1, 2, 3):
            own = np.flatnonzero(length == n)
            parts = [words.take(pa.array(x[own])) for x in ids[:n]]
            place[own] = np.arange(len(own)) + sum(map(len, made))
            made.append(pc.binary_join_element_wise(*parts, b" ") if n > 1 else parts[0])
        phrases = pa.concat_arrays(made).take(pa.array(place))
        cuts = np.flatnonzero(np.diff(unit, prepend=-1, append=-1)).tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(unit[a]), lang, packed(phrases[a:b], counts[a:b])


def packed(phrases: pa.Array, counts: np.ndarray) -> bytes:
    """A sorted run as a compressed Arrow stream."""
    batch = pa.record_batch([phrases, pa.array(counts, pa.int64())], names=["phrase", "n"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(run: bytes) -> pa.Table:
    return pa.ipc.open_stream(run).read_all()


def merged(runs: list[pa.Table]) -> pa.Table:
    """The counts of equal phrases of one language added up."""
    t = pa.concat_tables(runs).group_by("phrase").aggregate([("n", "sum")])
    return t.select(["phrase", "n_sum"]).rename_columns(["phrase", "n"])


def phrase_counts(docs: DataFrame, least: int = LEAST, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, phrase, n): all contiguous n-grams of one to three words that occur `least` times or more, exact.

    n counts every occurrence within a piece. The empty phrase stands for all words of the language together and always has a
    row. A null text counts as empty, a null language as `und`.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    units = UNITS * max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    source = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("__lang"), F.col(text).cast("string").alias("__text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(units)
        named = lambda runs: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*runs, strict=True), (pa.int32(), pa.string(), pa.binary()), strict=True)], names=["unit", "lang", "run"])
        for block in blocks(batches, "__text", CHUNK):
            by: dict[str, list[str | None]] = {}
            for own, body in zip(block.column("__lang").to_pylist(), block.column("__text").to_pylist(), strict=True):
                by.setdefault(own, []).append(body)
            for own, texts in by.items():
                for run in counter.feed(own, texts):
                    yield named([run])
        for run in counter.close():
            yield named([run])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size = None, [], 0

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                t = merged(held)
                t = t.filter(pc.or_(pc.greater_equal(t["n"], least), pc.equal(t["phrase"], pa.scalar(b"", pa.binary()))))
                for b in t.to_batches(max_chunksize=50_000):
                    yield pa.RecordBatch.from_arrays([pa.array([at[1]] * len(b), pa.string()), b.column(0).cast(pa.string()), b.column(1)], names=["lang", "phrase", "n"])

        for batch in batches:
            for unit, own, run in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (unit, own) != at:
                    yield from done()
                    at, held, size = (unit, own), [], 0
                held.append(unpacked(run))
                size += len(held[-1])
                if size > WAITING:
                    held = [merged(held)]
                    size = WAITING // 2 if len(held[0]) < WAITING // 2 else 0
        yield from done()

    runs = source.mapInArrow(count, "unit int, lang string, run binary")
    ordered = runs.repartition("unit", "lang").sortWithinPartitions("unit", "lang")
    return ordered.mapInArrow(merge, "lang string, phrase string, n long")


def _scored(a: str, pairs: list[tuple[str, str]]):
    """The lowest-scoring cut, the earliest of equal ones, as a struct of score, k, l and r. Exact to 38 digits."""
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = []
    for k, (left, right) in enumerate(pairs, 1):
        score = F.expr(f"cast(1000000 * cast({a} as decimal(38,0)) * cast({a} as decimal(38,0)) as decimal(38,0)) div (cast({left} as decimal(38,0)) * cast({right} as decimal(38,0)))")
        cuts.append(F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r")))
    return F.array_min(F.array(*cuts))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of two to three words of each language.

    a, l, r: occurrences of the phrase and of either side of its lowest-scoring cut; n: all words of the language; score:
    floor(10^6 a^2 / (l r)), exact for counts below 10^16. Null texts count as empty, null languages as `und`; a language without
    phrases of `least` occurrences has no row, nor has an empty table. Equal rows all count. Other columns are not read.
    """
    freq = materialize(phrase_counts(docs, least, text, lang))
    words = F.split("phrase", " ")
    sized = freq.withColumn("k", F.when(F.col("phrase") == "", 0).otherwise(F.size(words)))
    of = lambda k, word, name: sized.filter(F.col("k") == k).select("lang", F.col("phrase").alias(word), F.col("n").alias(name))
    cand = sized.filter("k >= 2").select("lang", "phrase", "k", F.col("n").alias("a"), words[0].alias("w1"), F.element_at(words, -1).alias("wz"))
    cand = salted_join(cand, of(1, "w1", "f1"), ["lang", "w1"], by="phrase")
    cand = materialize(salted_join(cand, of(1, "wz", "fz"), ["lang", "wz"], by="phrase"))
    three = cand.filter("k = 3").withColumns({"head": F.substring_index("phrase", " ", 2), "tail": F.substring_index("phrase", " ", -2)})
    pairs = three.join(of(2, "head", "fh"), ["lang", "head"]).join(of(2, "tail", "ft"), ["lang", "tail"])
    longer = three.select("lang", "a", F.explode(F.array("head", "tail")).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    two = cand.filter("k = 2").join(longer, ["lang", "phrase"], "left")
    two = two.filter(F.col("longest").isNull() | (F.col("longest") * 100 < F.col("a") * COVERED))
    best = two.select("lang", "phrase", "a", _scored("a", [("f1", "fz")]).alias("c")).union(pairs.select("lang", "phrase", "a", _scored("a", [("f1", "ft"), ("fh", "fz")]).alias("c")))
    flat = best.select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    first = flat.withColumn("__part", part).withColumn("__at", F.row_number().over(Window.partitionBy("lang", "__part").orderBy(*order)))
    ranked = first.filter(F.col("__at") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    all_words = sized.filter("k = 0").select("lang", "n")
    return ranked.filter(F.col("rank") <= top).join(all_words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The rows of collocations() over `documents`, for DuckDB.
SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), listed AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM listed),
grams AS (
  SELECT lang, 1 AS k, w[i] AS phrase FROM places
  UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1] FROM places WHERE i + 1 <= len(w)
  UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM places WHERE i + 2 <= len(w)
), f AS (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 10),
cuts AS (
  SELECT lang, k, phrase, a, 1 AS cut, w[1] AS lhs, array_to_string(w[2:], ' ') AS rhs FROM c
  UNION ALL SELECT lang, k, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM c WHERE k = 3
), scored AS (
  SELECT cuts.*, x.n AS l, y.n AS r, (1000000::HUGEINT * a * a) // (x.n::HUGEINT * y.n) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = lhs JOIN f y ON y.lang = cuts.lang AND y.phrase = rhs
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (
  SELECT lang, part, max(a) AS a FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS part FROM c WHERE k = 3) GROUP BY ALL
), kept AS (SELECT best.* FROM best LEFT JOIN longer ON longer.lang = best.lang AND part = phrase WHERE longer.a IS NULL OR 100 * longer.a < 50 * best.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, totals.n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN totals ON totals.lang = ranked.lang WHERE rank <= 2000"""
