"""N-gram Jaccard join: MinHash buckets propose pairs, a Bayesian test prunes them, the shingles decide the rest.

Equal texts form one class first; links run between different texts. Texts that share a bucket with few others are
paired with all of them. The texts of large buckets are dealt anew by longer keys. What is still crowded after that, groups
of texts almost equal, is described by what each text has otherwise than most of its group. How many shingles
two texts share then follows from how many each lacks, but for differences that both have. Differences that many texts have
are part of a text's profile (its number of shingles, of lacking ones, and such differences); texts of one profile have the same
links by these alone, so profiles are compared instead of texts. Pairs that need a rarer common difference to reach the
threshold share one of few texts each, and are candidates like all others. So every link is counted, and what is shuffled
grows with the texts, not with the pairs of a group.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ARROW_ROWS, blocks, materialize, salted_join, words_of
from .graph import components

WORDS = 5
THRESHOLD = 0.8
HASHES, BAND_ROWS = 96, 4
REKEY_BANDS, REKEY_ROWS = 48, 6
#: Texts in a bucket that are still all paired; beyond it the longer keys take over.
BUCKET = 32
#: Texts in a block of a crowded group and shingles in it, on average at most, and profiles in a block of them.
BLOCK_TEXTS, BLOCK_SHINGLES, BLOCK_PROFILES = 128, 400_000, 512
#: Texts of a group that have a difference in common, from which on it belongs to their profiles.
COMMON = 32
#: Hashes compared between two tests, and the chance of reaching the threshold below which a pair is dropped.
STEP, TOLERANCE = 16, 1e-9
MUL = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all documents, and the documents' lengths."""
    import xxhash

    known: dict[bytes, int] = {}
    at = [known.setdefault(w, len(known)) for d in docs for w in d]
    table = np.array([xxhash.xxh64_intdigest(w) for w in known], np.uint64)
    return table[np.array(at, np.int64)] if at else table, np.array([len(d) for d in docs], np.int64)


def shingles(docs: list[list[bytes]], size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every `size` consecutive words (of all words of a shorter text), and how many each document has."""
    w, lens = word_hashes(docs)
    counts = np.where(lens >= size, lens - size + 1, (lens > 0).astype(np.int64))
    if not len(w):
        return w, counts
    padded = np.concatenate([w, np.zeros(size, np.uint64)])
    left = np.repeat(np.cumsum(lens), lens) - np.arange(len(w))  # words up to the document's end
    h = np.zeros(len(w), np.uint64)
    for k in range(size):
        h = h * MUL + np.where(left > k, padded[k : k + len(w)], np.uint64(1))
    h = (h ^ (h >> np.uint64(29))) * MUL
    first = np.arange(len(w)) - np.repeat(np.cumsum(lens) - lens, lens)
    return h[(left >= size) | ((first == 0) & (left < size))], counts


@lru_cache(maxsize=2)
def _mixers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def signatures(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """MinHash values, 32 bits each, of the documents that have shingles."""
    counts = counts[counts > 0]
    out = np.empty((len(counts), HASHES), np.uint32)
    if len(counts):
        starts = np.cumsum(counts) - counts
        for j, (a, b) in enumerate(zip(*_mixers(HASHES), strict=True)):
            out[:, j] = np.minimum.reduceat(((h * a + b) >> np.uint64(32)).astype(np.uint32), starts)
    return out


@lru_cache(maxsize=4)
def least_matches(threshold: float, step: int = STEP, hashes: int = HASHES, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """After each step, the fewest equal values at which a similarity of `threshold` is still likelier than `tolerance`.

    With a flat prior the similarity given m of n equal values has the distribution Beta(m + 1, n - m + 1).
    """
    x = (np.arange(20000) + 0.5) / 20000
    out = []
    for n in range(step, hashes + 1, step):
        for m in range(n + 1):
            log_pdf = lgamma(n + 2) - lgamma(m + 1) - lgamma(n - m + 1) + m * np.log(x) + (n - m) * np.log1p(-x)
            if np.exp(log_pdf)[x >= threshold].sum() / 20000 >= tolerance:
                break
        out.append(m)
    return tuple(out)


def survivors(a: np.ndarray, b: np.ndarray, least: tuple[int, ...]) -> np.ndarray:
    """Which pairs of signatures pass every test; a pair that failed is not compared further."""
    live, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, m in enumerate(least):
        part = slice(k * STEP, (k + 1) * STEP)
        matches[live] += (a[live, part] == b[live, part]).sum(axis=1)
        live = live[matches[live] >= m]
    return live


def _signed(batches):
    for block in blocks(batches, "text"):
        docs = [words_of(t) for t in block.column("text").to_pylist()]
        sig = iter(signatures(*shingles(docs)))
        keys = [hashlib.md5(b" ".join(d)).digest() if d else None for d in docs]
        sigs = [next(sig).tobytes() if d else None for d in docs]
        yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "key", "sig"])


def _sets(batches):
    for block in blocks(batches, "text"):
        docs = [words_of(t) for t in block.column("text").to_pylist()]
        h, counts = shingles(docs)
        cuts = np.cumsum(counts)[:-1]
        sets = [np.unique(x).view(np.int64) for x in np.split(h, cuts)]
        keys = [hashlib.md5(b" ".join(d)).digest() if d else None for d in docs]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["key", "set"])


def _rekeyed(batches):
    rng = np.random.default_rng(21)
    picks = [np.sort(rng.choice(HASHES, REKEY_ROWS, replace=False)) for _ in range(REKEY_BANDS)]
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.stack([np.frombuffer(s, np.uint32) for s in batch.column("sig").to_pylist()]).astype(np.uint64)
        for band, pick in enumerate(picks):
            h = np.full(len(sig), band + 1, np.uint64)
            for column in pick:
                h = (h ^ sig[:, column]) * MUL
                h ^= h >> np.uint64(31)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(h.view(np.int64))], names=["key", "bucket"])


def _tested(least):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.stack([np.frombuffer(s, np.uint32) for s in batch.column(c).to_pylist()]) for c in ("sig_a", "sig_b"))
                live = pa.array(survivors(a, b, least))
                yield pa.RecordBatch.from_arrays([batch.column("a").take(live), batch.column("b").take(live)], names=["a", "b"])

    return run


def _in_buckets(bands: DataFrame) -> DataFrame:
    """(bucket, key, n) of buckets with two texts or more."""
    sizes = bands.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    return materialize(salted_join(bands, sizes, ["bucket"], by="key"))


def _all_pairs(members: DataFrame) -> DataFrame:
    """Pairs within buckets of BUCKET texts at most; buckets of the same texts count once."""
    sets = members.groupBy("bucket").agg(F.sort_array(F.collect_list("key")).alias("s")).select("s").distinct()
    pair = "flatten(transform(sequence(1, size(s) - 1), i -> transform(slice(s, i + 1, size(s)), y -> struct(element_at(s, i) AS a, y AS b))))"
    return sets.select(F.expr(f"explode({pair}) AS p")).select("p.a", "p.b")


def candidates(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of text keys that share a bucket of few, and crowded groups (key, root), see the module's text.

    signed: (key, sig), one row per text. No pair has both texts in one group.
    """
    n = HASHES // BAND_ROWS
    keys = F.array(*[F.xxhash64(F.lit(k), F.substring("sig", 1 + 4 * BAND_ROWS * k, 4 * BAND_ROWS)) for k in range(n)])
    members = _in_buckets(signed.select("key", F.explode(keys).alias("bucket")))
    pairs = _all_pairs(members.filter(F.col("n") <= BUCKET))
    crowded = members.filter(F.col("n") > BUCKET).select("key").distinct()
    again = _in_buckets(signed.join(crowded, "key").select("key", "sig").mapInArrow(_rekeyed, "key binary, bucket long"))
    pairs = pairs.union(_all_pairs(again.filter(F.col("n") <= BUCKET)))
    close = again.filter(F.col("n") > BUCKET)
    hubs = close.groupBy("bucket").agg(F.min("key").alias("hub"))
    groups = components(salted_join(close, hubs, ["bucket"], by="key").filter("key <> hub").select(F.col("key").alias("a"), F.col("hub").alias("b")).distinct())
    groups = materialize(groups.select(F.col("node").alias("key"), "root"))
    in_a, in_b = (groups.select(F.col("key").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
    apart = pairs.distinct().join(in_a, "a", "left").join(in_b, "b", "left").filter("root_a is null or root_b is null or root_a <> root_b")
    return apart.select("a", "b"), groups


def shared(sets_a: list[np.ndarray], sets_b: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections between two lists of sets, by products of incidence matrices, some columns at a time."""
    out = np.zeros((len(sets_a), len(sets_b)), np.float32)
    flat_a, flat_b = np.concatenate(sets_a), np.concatenate(sets_b)
    own_a, own_b = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (sets_a, sets_b))
    common = np.intersect1d(flat_a, flat_b)
    for start in range(0, len(common), columns):
        part = common[start : start + columns]
        sides = []
        for flat, own, rows in ((flat_a, own_a, len(sets_a)), (flat_b, own_b, len(sets_b))):
            at = np.minimum(np.searchsorted(part, flat), len(part) - 1)
            hit = part[at] == flat
            side = np.zeros((rows, len(part)), np.float32)
            side[own[hit], at[hit]] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out


def reaches(both, size_a, size_b, threshold: float):
    """Whether sets of these sizes with so many common shingles reach the threshold; for columns and for arrays alike."""
    return both >= threshold * (size_a + size_b - both)


def _usual(t: pa.Table) -> pa.Table:
    """The shingles of most texts of one block: whichever set a group is described by, its links are the same."""
    sets = [np.array(x, np.int64) for x in t.column("set").to_pylist()]
    kinds, n = np.unique(np.concatenate(sets), return_counts=True)
    return pa.table({"root": t.column("root").slice(0, 1), "set": pa.array([kinds[2 * n > len(sets)]], pa.list_(pa.int64()))})


def _differences(t: pa.Table) -> pa.Table:
    """Texts of a block of a group against the usual shingles of the group, the row without key: those lacking or added."""
    keys = t.column("key").to_pylist()
    sets = [np.array(x, np.int64) for x in t.column("set").to_pylist()]
    own = sets[keys.index(None)]  # one row of each block
    rows = [(k, np.setdiff1d(own, x, assume_unique=True), np.setdiff1d(x, own, assume_unique=True), len(x)) for k, x in zip(keys, sets, strict=True) if k is not None]
    return pa.table(
        {
            "root": pa.array([t.column("root")[0].as_py()] * len(rows), pa.binary()), "key": pa.array([r[0] for r in rows], pa.binary()),
            "whole": pa.array([len(own)] * len(rows), pa.int32()), "size": pa.array([r[3] for r in rows], pa.int32()),
            "lacks": pa.array([len(r[1]) for r in rows], pa.int32()), "other": pa.array([np.concatenate(r[1:3]) for r in rows], pa.list_(pa.int64())),
        }
    )


def _profile_links(threshold: float):
    """Between two blocks of a group's profiles: (rep, near, n): links of each text of a profile, and a profile it meets."""

    def run(t: pa.Table) -> pa.Table:
        reps, blk = t.column("rep").to_pylist(), np.array(t.column("blk").to_pylist())
        whole, size, lacks, texts = (np.array(t.column(c).to_pylist(), np.int64) for c in ("whole", "size", "lacks", "texts"))
        common = [np.array(x, np.int64) for x in t.column("common").to_pylist()]
        first, second = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        a, b = np.flatnonzero(blk == first), np.flatnonzero(blk == second)
        degree, near = np.zeros(len(reps), np.int64), np.arange(len(reps))
        if len(a) and len(b):
            both = shared([common[x] for x in a], [common[x] for x in b]).astype(np.int64) + whole[0] - lacks[a][:, None] - lacks[b][None]
            linked = reaches(both, size[a][:, None], size[b][None], threshold)
            degree[a] = linked @ texts[b]
            if first == second:
                degree[a] -= linked.diagonal()  # no text is its own copy
            else:
                degree[b] = texts[a] @ linked
            while True:  # the least of the profiles that each is connected with
                best = near.copy()
                best[a] = np.minimum(best[a], np.where(linked, near[b][None], len(reps)).min(axis=1))
                best[b] = np.minimum(best[b], np.where(linked, best[a][:, None], len(reps)).min(axis=0))
                if (best == near).all():
                    break
                near = best
        some = np.flatnonzero(degree)
        return pa.table({"rep": pa.array([reps[x] for x in some], pa.binary()), "near": pa.array([reps[near[x]] for x in some], pa.binary()), "n": pa.array(degree[some])})

    return run


def _in_groups(groups: DataFrame, sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of crowded groups: pairs (a, b) to be tested, edges (a, b) and link counts (key, n) of all pairs that need no test."""
    held = materialize(groups.join(sets, "key"))
    blocks_of = F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum(F.size("set").cast("long")) / BLOCK_SHINGLES)).cast("int").alias("nb")
    sizes = held.groupBy("root").agg(blocks_of)
    dealt = salted_join(held, sizes, ["root"], by="key")
    dealt = dealt.select("root", "key", "set", F.pmod(F.xxhash64("key", F.lit(5)), F.col("nb")).cast("int").alias("blk"))
    first = dealt.join(dealt.groupBy("root").agg(F.min("blk").alias("blk")), ["root", "blk"])
    usual = first.groupBy("root").applyInArrow(_usual, "root binary, set array<long>").join(sizes, "root")
    own = usual.select("root", F.lit(None).cast("binary").alias("key"), "set", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("blk"))
    told = dealt.unionByName(own).groupBy("root", "blk").applyInArrow(_differences, "root binary, key binary, whole int, size int, lacks int, other array<long>")
    told = materialize(told)
    each = told.select("root", "key", F.explode("other").alias("e"))
    often = each.groupBy("root", "e").agg(F.count("*").alias("n")).filter("n > 1")
    each = materialize(salted_join(each, often, ["root", "e"], by="key"))
    common = each.filter(F.col("n") > COMMON).groupBy("key").agg(F.sort_array(F.collect_list("e")).alias("common"))
    told = told.drop("other").join(common, "key", "left").withColumn("common", F.coalesce("common", F.array().cast("array<long>")))
    told = materialize(told.withColumn("profile", F.md5(F.concat_ws(",", F.hex("root"), "size", "lacks", F.col("common").cast("array<string>")))))

    side = lambda c: told.select(F.col("key").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("whole", "size", "lacks", "common")])
    pairs = _all_pairs(each.filter(F.col("n") <= COMMON).select(F.struct("root", "e").alias("bucket"), "key")).distinct().join(side("a"), "a").join(side("b"), "b")
    both = F.col("whole_a") - F.col("lacks_a") - F.col("lacks_b") + F.size(F.array_intersect("common_a", "common_b"))
    pairs = pairs.filter(~reaches(both, F.col("size_a"), F.col("size_b"), threshold)).select("a", "b")

    profiles = told.groupBy("profile").agg(*[F.first(c).alias(c) for c in ("root", "whole", "size", "lacks", "common")], F.min("key").alias("rep"), F.count("*").alias("texts"))
    profiles = materialize(profiles)
    count = profiles.groupBy("root").agg(F.ceil(F.count("*") / BLOCK_PROFILES).cast("int").alias("nb"))
    met = salted_join(profiles, count, ["root"], by="rep").withColumn("blk", F.pmod(F.xxhash64("rep", F.lit(6)), F.col("nb")).cast("int"))
    met = met.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumns({"i": F.least("blk", "with"), "j": F.greatest("blk", "with")})
    met = materialize(met.groupBy("root", "i", "j").applyInArrow(_profile_links(threshold), "rep binary, near binary, n long"))
    degree = met.groupBy("rep").agg(F.sum("n").alias("n")).join(profiles.select("rep", "profile"), "rep")
    inside = materialize(salted_join(told.select("key", "profile"), degree, ["profile"], by="key").select("key", "rep", "n"))
    edges = inside.select(F.col("key").alias("a"), F.col("rep").alias("b")).union(met.select("rep", "near")).filter("a <> b").distinct()
    return pairs, edges, inside.select("key", "n")


def _texts_of(docs: DataFrame, owners: DataFrame, need: DataFrame, text: str) -> DataFrame:
    """The texts of one document for each key that is needed; rows without id, one key, are dealt by their text."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name")
    names = owners.join(need, "key").select(name).distinct()
    return salted_join(docs.select(name, F.col(text).cast("string").alias("text")), names, ["name"], by="text", how="left_semi", salts=4)


def links(docs: DataFrame, signed: DataFrame, owners: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(a, b) that connect each class of different texts, and (key, n_links): the pairs that reach the threshold.

    owners: (key, doc_id), one document for each text, from which its shingles are taken.
    """
    a, b = (signed.select(F.col("key").alias(c), F.col("sig").alias(f"sig_{c}")) for c in "ab")
    tested = lambda p: p.join(a, "a").join(b, "b").mapInArrow(_tested(least_matches(threshold)), "a binary, b binary")
    pairs, groups = candidates(signed)
    pairs = materialize(tested(pairs))
    need = materialize(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).union(groups.select("key")).distinct())
    sets = _texts_of(docs, owners, need, text).mapInArrow(_sets, "key binary, set array<long>").join(need, "key", "left_semi")
    sets = materialize(sets.dropDuplicates(["key"]))
    inner, edges, counted = _in_groups(groups, sets, threshold)
    pairs = pairs.union(tested(inner))
    sa, sb = (sets.select(F.col("key").alias(c), F.col("set").alias(f"set_{c}")) for c in "ab")
    both = F.size(F.array_intersect("set_a", "set_b"))
    found = pairs.join(sa, "a").join(sb, "b").filter(reaches(both, F.size("set_a"), F.size("set_b"), threshold)).select("a", "b")
    found = materialize(found)
    one = F.lit(1).cast("long").alias("n")
    degree = found.select(F.col("a").alias("key"), one).union(found.select("b", one)).union(counted)
    return found.union(edges), degree.groupBy("key").agg(F.sum("n").alias("n_links"))


def near_copies(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row doc_id, class_id (least id of the connected class), n_copies (rows of an equal text) and n_links.

    Similarity: Jaccard of the sets of five consecutive words, words being `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` with A-Z
    lower-cased; a shorter text is one shingle. n_links: different texts that reach the threshold with this one. A pair at
    the threshold is missed with a chance of some 3e-6 (no common bucket). Texts without words, null ones too, are alone in their
    class. Rows without id count, but name no class. Repeated rows are copies.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    source = docs.select("doc_id", F.col(text).cast("string").alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    rows = materialize(source.mapInArrow(_signed, f"doc_id {id_type}, key binary, sig binary"))
    texts = rows.filter("key is not null").groupBy("key").agg(F.first("sig").alias("sig"), F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"))
    texts = materialize(texts)
    found, degree = links(docs, texts.select("key", "sig"), texts.select("key", "doc_id"), text, threshold)
    roots = components(found).withColumnRenamed("node", "key").join(degree, "key")
    named = texts.drop("sig").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    named = salted_join(named, least, ["root"], by="key").select("key", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    worded = rows.filter("key is not null").select("doc_id", "key")
    full = salted_join(worded, named, ["key"], by="doc_id", salts=4)
    alone = rows.filter("key is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"))
    return full.select("doc_id", "class_id", "n_copies", "n_links").unionByName(alone)
