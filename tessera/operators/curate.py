"""Curation: sampling, splitting, deduplication and leak control.

Every draw is by hash order (functions.text.hash_order), so it does not depend on partitions; picks differ from those of a
sequential random generator, the constraints do not.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hash_order, normalize_text
from .scoring import n_if
from .spread import discard, least_by_hash, matches, ordered_places, saved, saved_at, spread_join


def hash_ranks(df: DataFrame, by: Sequence[str], hashed: Column, key: str, digits: int = 3) -> DataFrame:
    """Adds __at, the place from 1 in the order of a hash and then of key within a group, and __size, the group's rows.

    A group is cut at the first hex digits of the hash, so that no task sees more of it than its 16 ** digits-th part: places
    within a part, plus the rows of the parts before it. Null group values are a group. Needs keys that seldom repeat.
    """
    cut = df.withColumn("__hash", hashed).withColumn("__part", F.substring("__hash", 1, digits))
    within = F.row_number().over(Window.partitionBy(*by, "__part").orderBy("__hash", key))
    parts, group = cut.groupBy(*by, "__part").agg(F.count("*").alias("__n")), Window.partitionBy(*by)
    before = F.sum("__n").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(*by, "__part", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__n").over(group).alias("__size"))
    placed = matches(cut.withColumn("__within", within), parts, [*by, "__part"])
    return placed.withColumn("__at", F.col("__before") + F.col("__within")).drop("__hash", "__part", "__within", "__before")


def text_key(col: Column) -> Column:
    return F.sha2(normalize_text(col), 256)


def paired_clips(texts: DataFrame, waves: DataFrame, speaker: str, stem: str) -> DataFrame:
    """Clips in both listings whose stem holds `_`, with sentence_id, the part after the first one."""
    both = texts.filter(F.col(stem).contains("_")).join(waves.select(speaker, stem).distinct(), [speaker, stem], "left_semi")
    return both.withColumn("sentence_id", F.expr(f"substr(`{stem}`, instr(`{stem}`, '_') + 1)"))


def eligible_clips(clips: DataFrame, duration: str, low: float, high: float, exclude: DataFrame | None = None, key: str = "clip_id", strict: bool = False) -> DataFrame:
    """Clips within the bounds (without their ends if strict) whose id is not excluded."""
    d = F.col(duration)
    kept = clips.filter((d > low) & (d < high) if strict else d.between(low, high))
    return kept.join(exclude.select(key).distinct(), key, "left_anti") if exclude is not None else kept


def even_targets(labels: DataFrame, label: str, total: int, seed: object | None = None) -> DataFrame:
    """(label, target): the total split evenly, the rest to the first labels by name, or in hash order with a seed."""
    d = labels.select(label).distinct()
    order = [F.col(label)] if seed is None else [hash_order(seed, F.col(label)), F.col(label)]
    n, at = F.count("*").over(Window.partitionBy()), F.row_number().over(Window.partitionBy().orderBy(*order))
    return d.select(label, n.alias("n"), at.alias("at")).select(label, (F.floor(F.lit(total) / F.col("n")) + (F.col("at") <= F.lit(total) % F.col("n")).cast("int")).cast("long").alias("target"))


def balanced_group_search(speakers: DataFrame, speaker: str, gender: str, accent: str, n: int, iters: int, seed: object, block: int = 1024) -> DataFrame:
    """The members of the best of `iters` draws of n speakers, with score and trial.

    Score: ten times the deviation of F and M counts from even targets, plus that of accent counts; the first best wins, so
    trials come in blocks and none follows a block with a score of 0. A table of fewer than n speakers is drawn whole, an
    empty one gives no rows.
    """
    spark = speakers.sparkSession
    members = saved(speakers.select(speaker, gender, accent))
    genders = even_targets(members.filter(F.col(gender).isin("F", "M")), gender, n).select(F.lit("g").alias("kind"), F.col(gender).alias("label"), "target")
    accents = even_targets(members, accent, n).select(F.lit("a").alias("kind"), F.col(accent).alias("label"), "target")
    targets, rows, best = genders.union(accents), members.count(), None
    for start in range(0, iters, block):
        picked, path = least_draws(members, speaker, n, rows, range(start, min(start + block, iters)), seed)
        found = _draw_scores(picked, gender, accent, targets).agg(F.min(F.struct("score", "trial")).alias("m")).first().m
        if found is not None and (best is None or found.score < best[0].score):
            if best is not None:
                discard(spark, best[2])
            best = found, picked, path
        else:
            discard(spark, path)
        if best is not None and best[0].score == 0:
            break
    if best is None:
        return members.filter(F.lit(False)).select("*", F.lit(None).cast("long").alias("trial"), F.lit(None).cast("long").alias("score"))
    (score, trial), drawn, _ = best
    return drawn.filter(F.col("trial") == trial).select(speaker, gender, accent, "trial", F.lit(score).cast("long").alias("score"))


def least_draws(members: DataFrame, speaker: str, n: int, rows: int, trials: range, seed: object) -> tuple[DataFrame, str]:
    """The first n rows of each trial in the order of its own hash, with trial; written, and where.

    Of the table's rows those below a share of the hash values can be among the first n; the share leaves some n + 8 sqrt(n)
    rows of a trial, whatever the table's size, and no other row is shuffled. Trials that got fewer than n are drawn again with
    a wider share, until none is short.
    """
    least, path, todo, spare = None, None, None, 8.0
    spark = members.sparkSession
    while True:
        share = (n + spare * (n**0.5 + 1)) / max(rows, 1)
        ids = F.explode(F.sequence(F.lit(trials[0]), F.lit(trials[-1])).cast("array<long>")) if todo is None else F.explode(F.array(*map(F.lit, todo)))
        draws = members.withColumn("trial", ids).withColumn("__hash", hash_order(seed, F.col("trial"), F.col(speaker)))
        if share < 1:
            draws = draws.filter(F.col("__hash") < f"{int(share * 2**64):016x}")
        place = F.row_number().over(Window.partitionBy("trial").orderBy("__hash", speaker))
        first = draws.withColumn("__at", place).filter(F.col("__at") <= n).drop("__hash", "__at")
        got, got_path = saved_at(first if least is None else least.join(F.broadcast(spark.createDataFrame([(t,) for t in todo], "trial long")), "trial", "left_anti").unionByName(first))
        if path is not None:
            discard(spark, path)
        least, path = got, got_path
        if share >= 1:
            return least, path
        full = {r.trial for r in least.groupBy("trial").count().filter(F.col("count") >= n).select("trial").collect()}
        todo, spare = [t for t in trials if t not in full], spare * 4
        if not todo:
            return least, path


def _draw_scores(picked: DataFrame, gender: str, accent: str, targets: DataFrame) -> DataFrame:
    """(trial, score) of every trial with members; targets: kind (g, a), label, target."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("label")) for k, c in (("g", gender), ("a", accent))])
    counts = picked.select("trial", F.explode(kinds).alias("x")).groupBy("trial", "x.kind", "x.label").agg(F.count("*").alias("c"))
    grid = picked.select("trial").distinct().crossJoin(targets)
    held = matches(grid, counts, ["trial", "kind", "label"], "left")
    off = F.abs(F.coalesce("c", F.lit(0)) - F.col("target")) * F.when(F.col("kind") == "g", 10).otherwise(1)
    return held.groupBy("trial").agg(F.sum(off).alias("score"))


def sample_per_group(df: DataFrame, group: str, key: str, k: int, seed: object) -> DataFrame:
    """k rows per group in hash order, numbered by key (item_no), with group_size; a group of fewer raises.

    Selected and numbered without bringing a group into one task, however large it or k is. Keys are unique within a group.
    """
    picked = least_by_hash(df, [group], hash_order(seed, F.col(group), F.col(key)), key, k)
    sizes = df.groupBy(group).agg(F.count("*").alias("group_size"))
    short = F.raise_error(F.concat(F.lit("too few rows in group "), F.coalesce(F.col(group).cast("string"), F.lit("null")))).cast("boolean")
    sizes = sizes.filter(F.when(F.col("group_size") < k, short).otherwise(True))
    numbered = ordered_places(picked, [key], "item_no", [group]).withColumn("item_no", (F.col("item_no") + 1).cast("int"))
    return matches(numbered, sizes, [group]).select(*df.columns, "group_size", "item_no")


def exclude_overlapping_text(train: DataFrame, held_out: DataFrame, text: str) -> DataFrame:
    """Rows of train whose normalised text is not among the held-out ones; joined on digests, the held-out side distinct."""
    keys = held_out.select(text_key(F.col(text)).alias("__k")).distinct()
    return train.withColumn("__k", text_key(F.col(text))).join(keys, "__k", "left_anti").drop("__k")


def unique_text_quota_sample(cands: DataFrame, speaker: str, key: str, text: str, targets: DataFrame, seed: object, max_rounds: int = 200, log: list | None = None) -> DataFrame:
    """Round-robin over speakers: each takes its next candidate (hash order) whose text nobody has, up to its target.

    (speaker, key, slot). Equal to the sequential greedy: every text ranks the slots (turn, speaker) alike, so slots bid down
    their speaker's list, each text goes to the least slot, and losers go on to the next candidate. The slots of one speaker
    keep list order, so a loser pushes on the slots right behind it, each to where the one before it stood. Of equal texts of
    one speaker the first is kept beforehand. An unmet target raises. targets: speaker, target.

    Bids are only ever added: a slot stands at its last bid, and a text's least bid is that of its holder, as a slot leaves a
    text only to a lesser one. So a round moves the bids of speakers who lost and those for the texts that they come to, and
    nothing else; the bids made in a round, and the losers, are counted into `log`. Only these counts reach the driver.
    """
    spark = cands.sparkSession
    hashed = hash_order(seed, F.col("speaker"), F.col("key"))
    c = cands.select(F.col(speaker).alias("speaker"), F.col(key).alias("key"), text_key(F.col(text)).alias("t")).filter("t is not null")
    c = c.groupBy("speaker", "t").agg(F.min(F.struct(hashed.alias("h"), "key")).alias("m")).select("speaker", "t", "m.key")
    c = saved(hash_ranks(c, ["speaker"], hashed, "key").select("speaker", "key", "t", F.col("__at").cast("long").alias("at")))
    wanted = targets.filter("target > 0").select(F.col(speaker).alias("speaker"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("target").cast("long"))).alias("slot"))
    moved, moved_path = saved_at(wanted.withColumn("at", F.col("slot")))
    paths: list[str] = []
    for _ in range(max_rounds):
        n_moved = moved.count()
        new, new_path = saved_at(matches(c, moved, ["speaker", "at"]).select("speaker", "slot", "at", "t", "key"))
        if new.count() < n_moved:
            raise ValueError("a speaker has too few texts that nobody else took")
        standing = new
        if paths:
            before = spark.read.schema(new.schema).parquet(*paths).join(new.select("t").distinct(), "t", "left_semi")
            holders = before.groupBy("t").agg(F.min(F.struct("slot", "speaker", "at", "key")).alias("m")).select("m.speaker", "m.slot", "m.at", "t", "m.key")
            standing = new.unionByName(matches(holders, moved.select("speaker", "slot"), ["speaker", "slot"], "left_anti"))
        best = standing.groupBy("t").agg(F.min(F.struct("slot", "speaker")).alias("best"))
        beaten = spread_join(standing, best, ["t"], F.struct("slot", "speaker")).filter(F.struct("slot", "speaker") != F.col("best"))
        lost, lost_path = saved_at(beaten.select("speaker", "slot", "at"))
        discard(spark, moved_path)
        paths.append(new_path)
        n_lost = lost.count()
        if log is not None:
            log.append((n_moved, n_lost))
        bids = spark.read.schema(new.schema).parquet(*paths)
        if not n_lost:
            discard(spark, lost_path)
            held = bids.groupBy("t").agg(F.min(F.struct("slot", "speaker", "key")).alias("m"))
            return held.select(F.col("m.speaker").alias(speaker), F.col("m.key").alias(key), F.col("m.slot").cast("int").alias("slot"))
        stood = matches(bids, lost.select("speaker").distinct(), ["speaker"], "left_semi").groupBy("speaker", "slot").agg(F.max("at").alias("at"))
        tried = matches(stood, lost.withColumn("gone", F.lit(1)), ["speaker", "slot", "at"], "left").withColumn("to", F.col("at") + F.coalesce("gone", F.lit(0)))
        ahead = F.max(F.col("to") - F.col("slot")).over(Window.partitionBy("speaker").orderBy("slot"))
        onward = tried.withColumn("to", ahead + F.col("slot")).filter("to > at")
        moved, moved_path = saved_at(onward.select("speaker", "slot", F.col("to").alias("at")))
        discard(spark, lost_path)
    raise ValueError("the rounds did not settle")


def greedy_quota(cands: Mapping[str, Sequence[tuple[object, str]]], targets: Mapping[str, int]) -> list[tuple[str, object, int]]:
    """The sequential rule on lists already in order, for tests: turns over speakers by name."""
    used, at, out = set(), dict.fromkeys(cands, 0), []
    for turn in range(1, max(targets.values(), default=0) + 1):
        for s in sorted(cands):
            if turn > targets[s]:
                continue
            while cands[s][at[s]][1] in used:
                at[s] += 1
            key, text = cands[s][at[s]]
            used.add(text)
            out.append((s, key, turn))
    return out


def capped_balanced_sample(df: DataFrame, stratum: str, speaker: str, key: str, target: int, cap: int, seed: object) -> DataFrame:
    """Up to `target` rows per stratum, at most `cap` of a speaker, in hash order; both by radix selection."""
    hashed = hash_order(seed, F.col(key))
    own = saved(least_by_hash(df, [stratum, speaker], hashed, key, cap))
    return least_by_hash(own, [stratum], hashed, key, target)


def dedup_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the order given."""
    rest = [c for c in df.columns if c not in key and c not in order]
    m = df.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("m"))
    return m.select(*key, *[F.col(f"m.{c}").alias(c) for c in df.columns if c not in key]).select(df.columns)


def disjoint_partition(df: DataFrame, speaker: str, key: str, n_train: int, n_test: int, attempts: int, seed: object) -> DataFrame:
    """(key, speaker, split, attempt): speakers split by a coin of weight n_test / (n_train + n_test), rows sampled on each side.

    The first attempt in which both sides have enough rows counts; without one it raises. Only row counts per speaker meet
    the attempts, each in its own partition. Each side's rows are found by radix selection.
    """
    sizes = df.groupBy(speaker).agg(F.count("*").alias("n"))
    coin = F.conv(F.substring(hash_order(seed, F.col("attempt"), F.col(speaker)), 1, 8), 16, 10).cast("double") / 4294967296.0
    test = coin < n_test / (n_train + n_test)
    tries = sizes.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1)).cast("array<long>"))).withColumn("test", test)
    room = tries.groupBy("attempt").agg(F.sum(F.when(F.col("test"), F.col("n")).otherwise(0)).alias("on_test"), F.sum(F.when(~F.col("test"), F.col("n")).otherwise(0)).alias("on_train"))
    first = room.filter((F.col("on_test") >= n_test) & (F.col("on_train") >= n_train)).agg(F.min("attempt").alias("attempt"))
    first = first.select(F.coalesce("attempt", F.raise_error(F.lit("no attempt has room on both sides")).cast("long")).alias("attempt"))
    sides = df.select(speaker, key).crossJoin(F.broadcast(first)).withColumn("split", F.when(test, "test").otherwise("train"))
    sides = saved(sides)
    return least_by_hash(sides, ["split"], hash_order(seed, F.col("split"), F.col(key)), key, F.when(F.col("split") == "test", n_test).otherwise(n_train))


def stratified_split(df: DataFrame, label: str, key: str, val_ratio: float, seed: object) -> DataFrame:
    """Adds split: per label max(1, round half even of n * ratio) rows to val, n - 1 at most; none at ratio 0."""
    if val_ratio <= 0:
        return df.withColumn("split", F.lit("train"))
    ranked, n = hash_ranks(df, [label], hash_order(seed, F.col(key)), key), F.col("__size")
    want = F.least(F.greatest(F.lit(1), F.bround(n * val_ratio).cast("long")), n - 1)
    return ranked.withColumn("split", F.when(F.col("__at") <= want, "val").otherwise("train")).drop("__at", "__size")


def fewshot_contexts(queries: DataFrame, train: DataFrame, query: str, key: str, category: str, label: str, shots: int, seed: object) -> DataFrame:
    """(query, label, train key, place): per query `shots` train rows of each label of its category, in an order of its own.

    Train rows are numbered per (category, label) in hash order; a query takes the number its own hash gives and others at
    even distances from it, all different. An equi-join on (category, label, number), so no query meets all train rows.
    """
    t = train.select(F.col(category), F.col(label), F.col(key).alias("train_key"))
    sizes = t.groupBy(category, label).agg(F.count("*").alias("size")).withColumn("k", F.least(F.col("size"), F.lit(shots)))
    t = hash_ranks(t, [category, label], hash_order(seed, F.col("train_key")), "train_key").withColumn("idx", (F.col("__at") - 1).cast("int")).drop("__at", "__size")
    q = queries.select(F.col(query), F.col(category)).join(sizes, category)
    start = F.conv(F.substring(hash_order(seed, F.col(query), F.col(label)), 1, 8), 16, 10).cast("long") % F.col("size")
    q = q.withColumn("start", start).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    q = q.withColumn("idx", ((F.col("start") + F.col("i") * F.greatest(F.lit(1), F.floor(F.col("size") / F.col("k")).cast("int"))) % F.col("size")).cast("int"))
    got = q.join(t, [category, label, "idx"]).select(query, category, label, "train_key")
    return got.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy(hash_order(seed, F.col(query), F.col("train_key")), "train_key")))


def annotation_subset(manifest: DataFrame, speaker: str, source: str, conditions: DataFrame) -> DataFrame:
    """One source per speaker, the least id; the i-th speaker gets condition i mod their number and direction i mod 2, joined to the manifest.

    conditions: at (from 0), tier, curve. manifest: speaker, source, tier, curve, direction.
    """
    first = manifest.groupBy(speaker).agg(F.min(source).alias(source))
    n = conditions.agg(F.count("*").alias("n_conditions"))
    first = ordered_places(first, [speaker], "i").crossJoin(F.broadcast(n)).withColumn("at", F.col("i") % F.col("n_conditions"))
    wanted = first.join(F.broadcast(conditions), "at").withColumn("direction", F.when(F.col("i") % 2 == 0, "up").otherwise("down")).drop("at", "i", "n_conditions")
    return manifest.join(wanted, [speaker, source, "tier", "curve", "direction"], "left_semi")


def union_origins(augmented: DataFrame, sources: DataFrame, categories: DataFrame, constant: str) -> DataFrame:
    """Augmented rows and, for every category, the unmodified sources labelled `constant`. Both: clip_id, label; augmented: category."""
    plain = sources.select("clip_id").crossJoin(F.broadcast(categories.select("category").distinct())).select("clip_id", "category", F.lit(constant).alias("label"), F.lit("source").alias("origin"))
    return augmented.select("clip_id", "category", "label", F.lit("augmented").alias("origin")).unionByName(plain)


def merge_bounds(clips: DataFrame, bounds: DataFrame, item: str, clip: str, values: Sequence[str]) -> DataFrame:
    """Bounds by item id first, else by clip id (its first item's row); without either nulls and detected false."""
    pick = lambda k, tag: bounds.filter(F.col(k).isNotNull()).groupBy(k).agg(F.min(F.struct(item, "detected", *values)).alias(tag))
    j = clips.join(pick(item, "__a"), item, "left").join(pick(clip, "__b"), clip, "left")
    found = F.coalesce("__a", "__b")
    return j.withColumns({"detected": F.coalesce(found["detected"], F.lit(False)), **{v: found[v] for v in values}}).drop("__a", "__b")


def bounds_coverage(clips: DataFrame, bounds: DataFrame, key: str) -> DataFrame:
    """(key, reason): clips whose bounds are missing, or there but not detected (invalid)."""
    missing = clips.select(key).join(bounds.select(key), key, "left_anti").withColumn("reason", F.lit("missing"))
    invalid = clips.select(key).join(bounds.filter(~F.coalesce("detected", F.lit(False))).select(key).distinct(), key, "left_semi").withColumn("reason", F.lit("invalid"))
    return missing.union(invalid)


def selection_report(df: DataFrame, speaker: str, text: str, duration: str, accent: str) -> DataFrame:
    """(measure, name, value): counts, durations, repeated texts, rows per accent, and how many speakers have how many rows."""
    texts = df.groupBy(text_key(F.col(text)).alias("t")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("rows"), F.countDistinct(speaker).alias("speakers"), F.min(duration).alias("min_duration"), F.max(duration).alias("max_duration"))
    total = total.crossJoin(texts.agg(n_if(F.col("n") > 1).alias("repeated_texts"), F.max("n").alias("max_frequency")))
    names = ("rows", "speakers", "min_duration", "max_duration", "repeated_texts", "max_frequency")
    head = total.select(F.explode(F.array(*[F.struct(F.lit("total").alias("measure"), F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])).alias("r")).select("r.*")
    by_accent = df.groupBy(accent).agg(F.count("*").cast("double").alias("value")).select(F.lit("accent").alias("measure"), F.col(accent).cast("string").alias("name"), "value")
    per = df.groupBy(speaker).agg(F.count("*").alias("c")).groupBy("c").agg(F.count("*").cast("double").alias("value")).select(F.lit("speakers_with").alias("measure"), F.col("c").cast("string").alias("name"), "value")
    return head.union(by_accent).union(per)


def check_dataset(test: DataFrame, train: DataFrame, bounds: DataFrame, expected: Mapping[str, float], key: str, speaker: str, text: str, direction: str) -> DataFrame:
    """(rule, actual, expected, ok): row counts, overlap of speakers and texts, repeated texts, missing bounds, balance of directions."""
    one = lambda d, rule: d.agg(F.count("*").cast("double").alias("actual")).select(F.lit(rule).alias("rule"), "actual")
    t = lambda d: d.select(text_key(F.col(text)).alias("t")).distinct()
    balance = test.agg((n_if(F.col(direction) == "up") - n_if(F.col(direction) == "down")).cast("double").alias("actual")).select(F.lit("direction_balance").alias("rule"), "actual")
    repeated = train.groupBy(text_key(F.col(text)).alias("t")).agg(F.count("*").alias("n")).filter("n > 1")
    rows = [
        one(test, "test_rows"), one(train, "train_rows"), one(test.select(speaker).intersect(train.select(speaker)), "shared_speakers"),
        one(t(test).join(t(train), "t", "left_semi"), "shared_texts"), one(repeated, "repeated_texts"), one(test.join(bounds.select(key).distinct(), key, "left_anti"), "missing_bounds"), balance,
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    want = F.create_map(*[x for k, v in expected.items() for x in (F.lit(k), F.lit(float(v)))])
    return out.withColumn("expected", F.try_element_at(want, F.col("rule"))).withColumn("ok", F.col("actual").eqNullSafe(F.col("expected")))


def check_release(rows: DataFrame, expected: DataFrame, category: str, key: str, path: str, direction: str, label: str) -> DataFrame:
    """(category, rule, n_found): counts other than expected, labels that contradict the direction, repeated keys, unsafe paths, shared destinations."""
    bad_label = ~F.coalesce(F.col(label) == F.when(F.col(direction) == "up", "increase").when(F.col(direction) == "down", "decrease"), F.lit(False))
    unsafe = F.col(path).startswith("/") | F.col(path).rlike(r"(^|/)\.\.(/|$)") | F.col(path).contains("\\")
    s = rows.groupBy(category).agg(F.count("*").alias("n"), n_if(bad_label).alias("bad_label"), n_if(unsafe).alias("unsafe_path"))
    again = lambda k, n: rows.groupBy(category, k).agg(F.count("*").alias("c")).groupBy(category).agg(n_if(F.col("c") > 1).alias(n))
    j = s.join(again(key, "duplicate_key"), category).join(again(path, "shared_path"), category).join(expected, category, "full")
    j = j.withColumn("wrong_count", F.when(~F.col("n").eqNullSafe(F.col("n_expected")), F.coalesce("n", F.lit(0))))
    kinds = F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).cast("long").alias("n_found")) for k in ("bad_label", "unsafe_path", "duplicate_key", "shared_path", "wrong_count")])
    return j.select(category, F.explode(kinds).alias("r")).select(category, "r.*").filter("n_found > 0 or rule = 'wrong_count' and n_found is not null")


def restructure_release(rows: DataFrame, split: str, category: str, key: str, origin: str) -> DataFrame:
    """Adds target_path and manifest; source rows also get selected_audio_path."""
    target = F.concat_ws("/", split, category, F.concat(F.col(key).cast("string"), F.lit(".wav")))
    return rows.withColumns({"target_path": target, "manifest": F.concat_ws("/", split, category, F.lit("manifest.csv")), "selected_audio_path": F.when(F.col(origin) == "source", F.concat(F.lit("source_clips/"), F.col(key).cast("string"), F.lit(".wav")))})


def samples_from_manifest(df: DataFrame, category: str, direction: str, order: Sequence[str], per_category: int | None = None, speakers: DataFrame | None = None, speaker: str = "speaker") -> DataFrame:
    """Rows of direction up or down with their gold label; the first n per category, or of given speakers alone."""
    out = df.filter(F.col(direction).isin("up", "down")).withColumn("gold_label", F.when(F.col(direction) == "up", "increase").otherwise("decrease"))
    if speakers is not None:
        out = out.join(speakers.select(speaker).distinct(), speaker, "left_semi")
    if per_category is not None:
        out = out.withColumn("__n", F.row_number().over(Window.partitionBy(category).orderBy(*order))).filter(F.col("__n") <= per_category).drop("__n")
    return out


def prompt_grid(samples: DataFrame, prompts: DataFrame) -> DataFrame:
    """Every sample with every asked attribute and its prompt; prompts, a small table: asked, prompt."""
    return samples.crossJoin(F.broadcast(prompts))
