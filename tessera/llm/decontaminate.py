"""Benchmark decontamination: one automaton over normalised test items, one scan of each text, offsets mapped back.

The automaton is an Aho-Corasick automaton whose symbols are words. Its patterns are the seeds of the items: each seven words
of an item that stand at a multiple of seven, and short items whole. A window of thirteen words holds one such seed, so every
place of a seed that grows to thirteen words with its item's neighbours gives all windows there, and none is missed. The
automaton thus has a node for each word of the benchmark at most, not thirteen.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, map_texts, words_of

WINDOW = 13
#: Words of a seed; a window holds one whole seed at a multiple of this in its item.
SEED = (WINDOW + 1) // 2
#: Characters of all items, at most: some 30 bytes of each task's memory for every word. A larger benchmark is refused.
MOST_CHARS = 64 << 20
#: Words that one lane of the scan goes through; lanes go on side by side.
LANE = 256


class Automaton:
    """Nodes in order of depth; a node's number is the place of its edge (parent, word) among all edges, plus one.

    keys: the edges as parent * n_words + word, ascending; fail: the node of the longest proper suffix; pattern: of the
    node itself, or -1; shorter: the nearest node down the failure links that has a pattern, or 0.
    """

    def __init__(self, patterns: list[tuple[int, ...]], n_words: int):
        self.n_words, self.longest = n_words, max(map(len, patterns), default=1)
        lens = np.array([len(p) for p in patterns], np.int64)
        words = np.zeros((len(patterns), self.longest), np.int64)
        words[np.repeat(np.arange(len(patterns)), lens), np.concatenate([np.arange(n) for n in lens] or [lens])] = [w for p in patterns for w in p]
        node = np.zeros(len(patterns), np.int64)
        self.keys, self.fail, self.pattern = np.zeros(0, np.int64), np.zeros(1, np.int32), np.full(1, -1, np.int32)
        self.shorter = np.zeros(1, np.int32)
        for d in range(self.longest if len(patterns) else 0):
            live = np.flatnonzero(lens > d)
            made, which = np.unique(node[live] * n_words + words[live, d], return_inverse=True)
            node[live] = which + len(self.fail)
            fail = self.step(self.fail[made // n_words], made % n_words) if d else np.zeros(len(made), np.int64)
            pattern = np.full(len(made), -1, np.int32)
            done = live[lens[live] == d + 1]
            pattern[node[done] - len(self.fail)] = done
            self.keys = np.concatenate([self.keys, made])
            self.shorter = np.concatenate([self.shorter, np.where(self.pattern[fail] >= 0, fail, self.shorter[fail]).astype(np.int32)])
            self.fail = np.concatenate([self.fail, fail.astype(np.int32)])
            self.pattern = np.concatenate([self.pattern, pattern])
        self.speaks = (self.pattern >= 0) | (self.shorter > 0)

    def step(self, node: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The nodes after reading a word in each of many lanes; word 0 is none of the benchmark's."""
        out, live = np.zeros(len(node), np.int64), np.flatnonzero(word)
        at = node[live].astype(np.int64)
        while len(live):
            key = at * self.n_words + word[live]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[place] == key
            out[live[found]] = place[found] + 1
            more = ~found & (at > 0)
            live, at = live[more], self.fail[at[more]].astype(np.int64)
        return out

    def scan(self, words: np.ndarray) -> list[tuple[int, int]]:
        """(end, pattern) of all places of all patterns, end excluded. Lanes overlap by the longest pattern but a word."""
        if not len(self.keys) or not len(words):
            return []
        before = self.longest - 1
        lanes = -(-len(words) // LANE)
        padded = np.zeros(before + lanes * LANE, np.int64)
        padded[before : before + len(words)] = words
        starts = np.arange(lanes) * LANE
        node, out = np.zeros(lanes, np.int64), []
        for k in range(before + LANE):
            node = self.step(node, padded[starts + k])
            if k >= before:
                for lane in np.flatnonzero(self.speaks[node]):
                    at = int(node[lane])
                    while at:
                        if self.pattern[at] >= 0:
                            out.append((int(starts[lane]) + k - before + 1, int(self.pattern[at])))
                        at = int(self.shorter[at])
        return out


class Benchmark:
    """The words of all items, the automaton of their seeds, and where each seed stands."""

    def __init__(self, items: list[tuple[str, str | None]]):
        self.words: dict[bytes, int] = {}
        self.ids: list[str] = []
        self.texts: list[np.ndarray] = []
        places: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for item, text in sorted({(i, tuple(words_of(t))) for i, t in items}):
            w = [self.words.setdefault(x, len(self.words) + 1) for x in text]
            if not w:
                continue
            n = SEED if len(w) >= WINDOW else len(w)
            for k in range(0, len(w) - n + 1, n):
                places.setdefault(tuple(w[k : k + n]), []).append((len(self.ids), k))
            self.ids.append(item)
            self.texts.append(np.array(w, np.int32))
        self.places = list(places.values())
        self.automaton = Automaton(list(places), len(self.words) + 1)

    def find(self, docs: list[list[bytes]]) -> list[dict[str, list[list[int]]]]:
        """Of each document the item ids whose windows occur, and the united word ranges that they cover."""
        get = self.words.get
        flat: list[int] = []
        starts = []
        for d in docs:
            starts.append(len(flat))
            flat += [get(w, 0) for w in d]
            flat.append(0)  # no pattern crosses it
        words = np.array(flat, np.int64)
        out: list[dict] = [{} for _ in docs]
        for end, pattern in self.automaton.scan(words):
            doc = int(np.searchsorted(starts, end - 1, "right")) - 1
            for item, at in self.places[pattern]:
                text = self.texts[item]
                size = min(SEED, len(text)) if len(text) >= WINDOW else len(text)
                lo, hi, to = end - size, end, at + size
                if len(text) >= WINDOW:
                    first, last = lo - min(at, WINDOW - size), hi + min(len(text) - to, WINDOW - size)
                    while lo > max(first, starts[doc]) and words[lo - 1] == text[at - 1]:
                        lo, at = lo - 1, at - 1
                    while hi < last and words[hi] == text[to]:
                        hi, to = hi + 1, to + 1
                    if hi - lo < WINDOW:
                        continue
                out[doc].setdefault(self.ids[item], []).append([lo - starts[doc], hi - starts[doc]])
        return [{i: united(spans) for i, spans in found.items()} for found in out]


def united(spans: list[list[int]]) -> list[list[int]]:
    """The union of ranges, end excluded; those that touch count as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def benchmark_of(items: DataFrame, item_id: str = "item_id", text: str = "text", most: int = MOST_CHARS) -> Benchmark:
    """Read the items, whose size Spark adds up first; more than `most` characters are an error."""
    source = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(text).cast("string").alias("t"))
    size = source.agg(F.coalesce(F.sum(F.coalesce(F.length("t"), F.lit(0)) + F.length("i")), F.lit(0))).first()[0]
    if size > most:
        raise ValueError(f"{size} characters of benchmark; one automaton takes {most}")
    t = source.toArrow()
    return Benchmark(list(zip(t.column("i").to_pylist(), t.column("t").to_pylist(), strict=True)))


def char_offsets(raw: bytes, at: np.ndarray) -> np.ndarray:
    """Character positions of byte positions of a UTF-8 text."""
    lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    return np.concatenate([[0], np.cumsum(lead)])[at]


def word_offsets(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a text begins and ends, in characters."""
    blank = np.concatenate([[True], np.frombuffer(raw.translate(WORD_BYTES), np.uint8) == 32, [True]])
    first = char_offsets(raw, np.flatnonzero(blank[:-1] & ~np.append(blank[1:-1], True)))
    return first, char_offsets(raw, np.flatnonzero(~blank[1:] & np.append(blank[2:], True)) + 1)


SCANNED = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, matches array<struct<item_id:string,start:int,end:int>>"


def contamination(docs: DataFrame, items: DataFrame, keep=("doc_id",), text: str = "text", most: int = MOST_CHARS) -> DataFrame:
    """Per document n_words, n_hit, n_items, items_sha256, contaminated, and matches: item ids with character offsets.

    A word inside any occurrence of a 13-word window of an item (of all words of a shorter one) is hit; contaminated if a
    twentieth of the words or more are. Null and empty texts have no words and are clean; an item without words matches
    nothing; one without id counts under the empty id; repeated documents and items each count as they stand; an empty
    benchmark hits nothing. Other columns than `keep` and the text are not read; kept ones named like a result give way.
    One scan of the texts, no shuffle; the automaton is built once, of a benchmark of at most `most` characters, whatever
    the number of documents, and broadcast.
    """
    shown = docs.sparkSession.sparkContext.broadcast(benchmark_of(items, most=most))

    def make():
        bench = shown.value

        def work(texts):
            raws = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
            words = [r.translate(WORD_BYTES).split() for r in raws]
            rows = []
            for raw, w, found in zip(raws, words, bench.find(words), strict=True):
                hit = sum(b - a for a, b in united([list(s) for spans in found.values() for s in spans]))
                first, last = word_offsets(raw) if found else ((), ())
                matches = [{"item_id": i, "start": int(first[a]), "end": int(last[b - 1])} for i in sorted(found) for a, b in found[i]]
                digest = hashlib.sha256(",".join(sorted(found)).encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((len(w), hit, len(found), digest, hit > 0 and 20 * hit >= len(w), matches))
            return {c.split()[0]: [r[i] for r in rows] for i, c in enumerate(SCANNED.split(", "))}

        return work

    return map_texts(docs, make, SCANNED, keep, text)


def brute(docs: list[str | None], items: list[tuple[str, str | None]], size: int = WINDOW) -> list[tuple]:
    """The same by comparing every window of every text, for tests: (n_words, n_hit, n_items, items_sha256, contaminated)."""
    known: dict[tuple, set[str]] = {}
    for i, t in items:
        w = words_of(t)
        n = min(size, len(w))
        for k in range(len(w) - n + 1) if n else ():
            known.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for t in docs:
        w, hit, ids = words_of(t), set(), set()
        for n in {len(k) for k in known}:
            for k in range(len(w) - n + 1):
                if got := known.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    ids |= got
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((len(w), len(hit), len(ids), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM
  (SELECT item_id, w, least({WINDOW}, len(w)) AS n, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM
  (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
h AS (SELECT r, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
hw AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN it USING (r)
"""
