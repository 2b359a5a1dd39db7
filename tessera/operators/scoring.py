"""Scoring of answers: one pass of conditional aggregates for each table of metrics."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def share(cond: Column, of: Column | None = None) -> Column:
    """Share of rows with `cond` among those with `of`; null without any."""
    hit = cond if of is None else cond & of
    return F.avg(F.when(F.lit(True) if of is None else of, F.coalesce(hit, F.lit(False)).cast("double")))


def n_if(cond: Column) -> Column:
    return F.coalesce(F.sum(F.coalesce(cond, F.lit(False)).cast("long")), F.lit(0)).cast("long")


def score_rows(df: DataFrame, raw: str = "raw_response", gold: str = "gold_label", error: str = "error", synonyms: str | None = None) -> DataFrame:
    """Adds gold (normalised), pred, ambiguous and failed; a stored prediction is not looked at."""
    wide = F.coalesce(F.col(synonyms), F.lit(False)) if synonyms else F.lit(False)
    unclear = F.when(wide, T.is_ambiguous(F.col(raw), T.INCREASE_SYNONYMS, T.DECREASE_SYNONYMS)).otherwise(T.is_ambiguous(F.col(raw)))
    return df.withColumns(
        {
            "gold": T.normalize_label(F.col(gold)), "pred": T.prediction_for_row(F.col(raw), F.col(error), wide), "ambiguous": unclear,
            "failed": F.col(error).isNotNull() & (F.col(error) != ""),
        }
    )


def _counts() -> list[Column]:
    pred, gold = F.col("pred"), F.col("gold")
    return [
        F.count("*").alias("n_rows"), n_if(pred.isNotNull()).alias("n_parsed"), n_if(pred.isNull()).alias("n_unparsed"),
        n_if(pred == gold).alias("n_correct"), n_if(F.col("ambiguous")).alias("n_ambiguous"), n_if(F.col("failed")).alias("n_error"),
        n_if((pred == "increase") & (gold == "increase")).alias("tp"), n_if((pred == "increase") & (gold == "decrease")).alias("fp"),
        n_if((pred == "decrease") & (gold == "increase")).alias("fn"), n_if((pred == "decrease") & (gold == "decrease")).alias("tn"),
        n_if(gold == "increase").alias("n_up"), n_if(gold == "decrease").alias("n_down"),
    ]


def _metrics(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    c = F.col
    up, down = F.try_divide(c("tp").cast("double"), c("n_up").cast("double")), F.try_divide(c("tn").cast("double"), c("n_down").cast("double"))
    known = F.array_compact(F.array(up, down))
    balanced = F.coalesce(F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known).cast("double")), F.lit(0.0))
    precision, recall = ratio(c("tp"), c("tp") + c("fp")), ratio(c("tp"), c("n_up"))
    return counts.select(
        *by, "n_rows", "n_parsed", "n_unparsed", "n_correct", "n_ambiguous", "n_error", "tp", "fp", "fn", "tn",
        ratio(c("n_correct"), c("n_rows")).alias("accuracy"), ratio(c("n_correct"), c("n_parsed")).alias("accuracy_parsed"),
        up.alias("accuracy_up"), down.alias("accuracy_down"), balanced.alias("balanced_accuracy"),
        precision.alias("precision_increase"), recall.alias("recall_increase"), ratio(2 * precision * recall, precision + recall).alias("f1_increase"),
        ratio(c("tp") + c("fp"), c("n_parsed")).alias("increase_ratio_parsed"), ratio(c("tp") + c("fp"), c("n_rows")).alias("increase_ratio_all"),
    )


def binary_metrics(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts and rates per group. Accuracy is over all rows; recalls keep unparsed rows and are null for an absent class."""
    return _metrics(scored.groupBy(*by).agg(*_counts()), by)


def summarize(scored: DataFrame, keys: Sequence[str] = ("category", "tier", "curve", "direction")) -> DataFrame:
    """(scope, key, metrics) overall and by each key, in one pass of grouping sets; a missing key is `unknown`."""
    filled = scored.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit("unknown")) for k in keys})
    sets = [[]] + [[F.col(k)] for k in keys]
    grouped = filled.groupingSets(sets, *keys).agg(*_counts())
    scope = F.coalesce(*[F.when(F.col(k).isNotNull(), F.lit(f"by_{k}")) for k in keys], F.lit("overall"))
    named = grouped.withColumn("scope", scope).withColumn("key", F.coalesce(*keys, F.lit("all")))
    return _metrics(named, ["scope", "key"])


def top_responses(df: DataFrame, file: str, raw: str, position: str, k: int = 20) -> DataFrame:
    """The k commonest answers per file; null counts as empty, ties go to the first to appear. Counted before it is ranked."""
    counts = df.groupBy(file, F.coalesce(F.col(raw), F.lit("")).alias("response")).agg(F.count("*").alias("n"), F.min(position).alias("first_at"))
    w = Window.partitionBy(file).orderBy(F.desc("n"), "first_at")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def constant_attributes(df: DataFrame, file: str, cols: Sequence[str]) -> DataFrame:
    """(file, attribute, value) of columns that hold one value, never null, all over a file."""
    aggs = [x for c in cols for x in (F.min(F.col(c).cast("string")).alias(f"lo_{c}"), F.max(F.col(c).cast("string")).alias(f"hi_{c}"), F.count(c).alias(f"n_{c}"))]
    g = df.groupBy(file).agg(F.count("*").alias("n"), *aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("attribute"), F.when((F.col(f"lo_{c}") == F.col(f"hi_{c}")) & (F.col(f"n_{c}") == F.col("n")), F.col(f"lo_{c}")).alias("value")) for c in cols])
    return g.select(file, F.explode(rows).alias("r")).select(file, "r.*").filter("value is not null")


#: Parsers that a run manifest may name, and whether rows of their files carry words for the answers.
PARSERS = {"main-unique-direction-v1": False, "synonym-unique-direction-v1": True}


def validate_predictions(df: DataFrame, expected: DataFrame, file: str, clip: str, gold: str = "gold_label", words: str | None = None) -> DataFrame:
    """(file, violation, n_found): invalid gold labels, missing and duplicate ids, and counts other than expected (file, n_expected).

    words: a boolean column, whether a row carries words for the answers; `expected` then names each file's parser too. Rows that
    do not go with it are parser_mismatch, all rows of a file whose parser is none of PARSERS unknown_parser.
    """
    worded = F.coalesce(F.col(words), F.lit(False)) if words else F.lit(False)
    per_clip = df.groupBy(file, clip).agg(F.count("*").alias("n"), n_if(T.normalize_label(F.col(gold)).isNull()).alias("bad"), n_if(worded).alias("worded"))
    per_file = per_clip.groupBy(file).agg(
        F.sum("n").alias("n"), F.sum("bad").alias("invalid_gold"), F.coalesce(F.sum(F.when(F.col(clip).isNull(), F.col("n"))), F.lit(0)).alias("missing_id"),
        n_if((F.col("n") > 1) & F.col(clip).isNotNull()).alias("duplicate_id"), F.sum("worded").alias("worded"),
    )
    j = per_file.join(expected, file, "full")
    wrong = F.when(~F.col("n").eqNullSafe(F.col("n_expected")), F.coalesce("n", F.lit(0))).otherwise(F.lit(None)).cast("long")
    counted = {k: F.col(k) for k in ("invalid_gold", "missing_id", "duplicate_id")}
    if words:
        known = F.coalesce(*[F.when(F.col("parser") == p, F.col("n") - F.col("worded") if needed else F.col("worded")) for p, needed in PARSERS.items()])
        counted |= {"parser_mismatch": known, "unknown_parser": F.when(known.isNull(), F.col("n"))}
    kinds = F.array(
        *[F.struct(F.lit(k).alias("violation"), F.when(c > 0, c).cast("long").alias("n_found")) for k, c in counted.items()],
        F.struct(F.lit("wrong_count").alias("violation"), wrong.alias("n_found")),
    )
    return j.select(file, F.explode(kinds).alias("v")).select(file, "v.*").filter("n_found is not null")


def check_manifest(manifest: DataFrame, path: str = "path") -> DataFrame:
    """(path, violation) of a run manifest: repeated, empty or unsafe paths (absolute, or with a part `..`), and paths whose
    results, the same name with the ending .json, would fall on those of another one."""
    each = manifest.groupBy(path).agg(F.count("*").alias("__n"))
    target = F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", ""), F.lit(".json"))
    shared = each.select(target.alias("__target")).groupBy("__target").agg(F.count("*").alias("__sharing"))
    j = each.withColumn("__target", target).join(shared, "__target", "left")
    empty = F.coalesce(F.trim(path) == "", F.lit(True))
    unsafe = F.col(path).startswith("/") | F.array_contains(F.split(path, "/"), "..")
    kinds = {"repeated_path": F.col("__n") > 1, "empty_path": empty, "unsafe_path": ~empty & unsafe, "colliding_output": ~empty & (F.col("__sharing") > 1)}
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()]))
    return j.select(path, F.explode(found).alias("violation"))


def check_options(df: DataFrame, key: str, scores: str, order: Sequence[str], labels: Sequence[str], gold: str, stored_option: str, stored_label: str) -> DataFrame:
    """(key, violation) of answers by option: scores that do not cover exactly the options with finite values, gold labels outside
    the domain, stored options or labels other than the best option and its label (null where nothing is stored), repeated keys.

    Where scores are invalid, what is stored is not judged.
    """
    best = T.argmax_option(F.col(scores), order)
    named = F.create_map(*[x for k, v in zip(order, labels, strict=True) for x in (F.lit(k), F.lit(v))])
    keys = F.map_keys(scores)
    whole = (F.size(keys) == len(order)) & F.forall(keys, lambda k: k.isin(*order))
    finite = F.forall(F.map_values(scores), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    fine = F.coalesce(whole & finite, F.lit(False))
    differs = lambda c, v: fine & F.col(c).isNotNull() & (F.col(c) != v)
    kinds = {
        "invalid_scores": ~fine, "invalid_gold": ~F.coalesce(F.col(gold).isin(*labels), F.lit(False)),
        "stored_option": differs(stored_option, best), "stored_label": differs(stored_label, F.element_at(named, best)),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()]))
    repeated = df.groupBy(key).agg(F.count("*").alias("__n")).filter("__n > 1").select(key, F.lit("duplicate_id").alias("violation"))
    return df.select(key, F.explode(found).alias("violation")).union(repeated)


def id_digest(df: DataFrame, file: str, clip: str) -> DataFrame:
    """SHA-256 of the sorted ids of a file joined by newlines, and their number; null ids are left out.

    This digest, as recorded elsewhere, can only be taken in order, so one task reads a file's ids, a batch at a time from a
    sort that spills; `id_set_digest` compares sets without an order over the whole file.
    """
    schema = type(df.schema)([df.schema[file]]).add("n", "long").add("id_sha256", "string")

    def digests(batches):
        now, taken, n = None, None, 0
        row = lambda: pa.RecordBatch.from_pylist([{file: now, "n": n, "id_sha256": taken.hexdigest()}], schema=pa.schema([kind, ("n", pa.int64()), ("id_sha256", pa.string())]))
        for batch in batches:
            kind = batch.schema.field(0)
            for name, clip_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if taken is None or name != now:
                    if taken is not None:
                        yield row()
                    now, taken, n = name, hashlib.sha256(), 0
                if clip_id is not None:
                    taken.update((b"\n" if n else b"") + clip_id.encode())
                    n += 1
        if taken is not None:
            yield row()

    ids = df.select(file, F.col(clip).cast("string").alias("__id")).repartition(file).sortWithinPartitions(file, "__id")
    return ids.mapInArrow(digests, schema)


def id_set_digest(df: DataFrame, by: Sequence[str], clip: Column, digits: int = 3) -> DataFrame:
    """(by, n, id_sha256): number and digest of the ids of a group, with how often each occurs; null ids are left out.

    Ids are cut into 16 ** digits ranges by the first hex digits of their SHA-256; a range's lines `id=times`, sorted, are
    digested, then the lines `range:digest` of a group. No row or task holds more of a group than one range of distinct ids.
    """
    text = clip.cast("string")
    times = df.select(*by, text.alias("__id")).filter("__id is not null").groupBy(*by, "__id").agg(F.count("*").alias("k"))
    line = F.struct("__id", F.concat_ws("=", "__id", F.col("k").cast("string")).alias("line"))
    digest = lambda lines: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(lines)), lambda x: x["line"]), "\n"), 256)
    ranges = times.groupBy(*by, F.substring(F.sha2("__id", 256), 1, digits).alias("__range")).agg(F.sum("k").alias("n"), digest(line).alias("d"))
    line = F.struct("__range", F.concat_ws(":", "__range", "d").alias("line"))
    return ranges.groupBy(*by).agg(F.sum("n").alias("n"), digest(line).alias("id_sha256"))


def compare_to_reference(metrics: DataFrame, expected: DataFrame, keys: Sequence[str], names: Sequence[str], tol: float = 1e-12) -> DataFrame:
    """(keys, metric, actual, recorded) where a recorded value is missed by more than `tol`, or absent on one side."""
    long = lambda d, v: d.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias(v)) for n in names])).alias("m")).select(*keys, "m.*")
    j = long(metrics, "actual").join(long(expected, "recorded"), [*keys, "metric"], "full")
    return j.filter(~F.coalesce(F.abs(F.col("actual") - F.col("recorded")) <= tol, F.col("actual").isNull() & F.col("recorded").isNull()))


def run_totals(summaries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals over categories and the two accuracies from them."""
    s = summaries.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n_rows", "n_parsed", "n_correct")])
    return s.select(*by, "n_rows", "n_parsed", "n_correct", ratio(F.col("n_correct"), F.col("n_rows")).alias("accuracy_all"), ratio(F.col("n_correct"), F.col("n_parsed")).alias("accuracy_parsed"))


def confusion(df: DataFrame, by: Sequence[str], pred: str = "pred", gold: str = "gold") -> DataFrame:
    """Counts of (prediction, gold); what was not parsed is `unparsed`."""
    return df.groupBy(*by, F.coalesce(F.col(pred), F.lit("unparsed")).alias("pred"), F.col(gold).alias("gold")).agg(F.count("*").alias("n"))


def multiclass_metrics(df: DataFrame, by: Sequence[str] = (), pred: str = "pred", gold: str = "gold") -> DataFrame:
    """Rows, parsed rows, and accuracy over parsed and over all."""
    p, g = F.col(pred), F.col(gold)
    s = df.groupBy(*by).agg(F.count("*").alias("n_rows"), n_if(p.isNotNull()).alias("n_parsed"), n_if(p == g).alias("n_correct"))
    return s.select(*by, "n_rows", "n_parsed", "n_correct", ratio(F.col("n_correct"), F.col("n_parsed")).alias("accuracy_parsed"), ratio(F.col("n_correct"), F.col("n_rows")).alias("accuracy_strict"))


def per_class_prf(df: DataFrame, labels: Sequence[str], by: Sequence[str] = (), pred: str = "pred", gold: str = "gold") -> DataFrame:
    """One row per group and label: tp, fp, fn, precision, recall, f1. Unparsed answers stay false negatives."""
    p, g = F.col(pred), F.col(gold)
    aggs = [x for i, v in enumerate(labels) for x in (n_if((p == v) & (g == v)).alias(f"tp{i}"), n_if((p == v) & (g != v)).alias(f"fp{i}"), n_if((g == v) & ~F.coalesce(p == v, F.lit(False))).alias(f"fn{i}"))]
    wide = df.groupBy(*by).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(v).alias("label"), *[F.col(f"{k}{i}").alias(k) for k in ("tp", "fp", "fn")]) for i, v in enumerate(labels)])
    c = wide.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.withColumns({"precision": precision, "recall": recall, "f1": ratio(2 * precision * recall, precision + recall)})


def macro_f1(df: DataFrame, labels: Sequence[str], by: Sequence[str] = (), pred: str = "pred", gold: str = "gold") -> DataFrame:
    return per_class_prf(df, labels, by, pred, gold).groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def class_accuracy(df: DataFrame, labels: Sequence[str], by: Sequence[str] = (), pred: str = "pred", gold: str = "gold") -> DataFrame:
    """Accuracy per gold class (acc_<label>), their mean (null if a class is absent) and accuracy over all rows."""
    right = F.coalesce(F.col(pred) == F.col(gold), F.lit(False))
    s = df.groupBy(*by).agg(*[share(right, F.col(gold) == v).alias(f"acc_{v}") for v in labels], share(right).alias("strict_accuracy"))
    total = F.lit(0.0)
    for v in labels:
        total = total + F.col(f"acc_{v}")
    return s.withColumn("macro_accuracy", total / len(labels))


def direction_difference(df: DataFrame, by: Sequence[str], pred: str = "pred", gold: str = "gold") -> DataFrame:
    """Accuracy on increase less that on decrease; null if either is absent."""
    c = class_accuracy(df, ("increase", "decrease"), by, pred, gold)
    return c.select(*by, "acc_increase", "acc_decrease", (F.col("acc_increase") - F.col("acc_decrease")).alias("difference"))


def prediction_distribution(df: DataFrame, category: str, group: str, labels: Sequence[str], pred: str = "pred") -> DataFrame:
    """Share of each answer per clip group within a category, then averaged equally over categories; other answers are `unparsed`."""
    names = [*labels, "unparsed"]
    p = F.when(F.col(pred).isin(*labels), F.col(pred)).otherwise("unparsed")
    s = df.withColumn("__p", p).groupBy(category, group).agg(*[share(F.col("__p") == v).alias(v) for v in names])
    m = s.groupBy(group).agg(*[F.avg(v).alias(v) for v in names])
    return m.select(group, F.explode(F.array(*[F.struct(F.lit(v).alias("label"), F.col(v).alias("share")) for v in names])).alias("r")).select(group, "r.*")


def prediction_transition(base: DataFrame, other: DataFrame, key: Sequence[str], source: str, target: str) -> DataFrame:
    """Of the clips that base calls `source`, how many other calls `target`; and ids on one side, and gold labels that differ."""
    j = base.select(*key, F.col("pred").alias("a"), F.col("gold").alias("ga"), F.lit(1).alias("ia")).join(other.select(*key, F.col("pred").alias("b"), F.col("gold").alias("gb"), F.lit(1).alias("ib")), list(key), "full")
    both = F.col("ia").isNotNull() & F.col("ib").isNotNull()
    s = j.agg(n_if(both & (F.col("a") == source)).alias("n_source"), n_if(both & (F.col("a") == source) & (F.col("b") == target)).alias("n_moved"), n_if(~both).alias("n_unmatched"), n_if(both & ~F.col("ga").eqNullSafe(F.col("gb"))).alias("n_gold_differs"))
    return s.withColumn("rate", ratio(F.col("n_moved"), F.col("n_source")))


def response_bias(df: DataFrame, by: Sequence[str], preferred: str = "increase", pred: str = "pred") -> DataFrame:
    """Parsed and unparsed counts and the preferred answer's rate over all and over parsed."""
    p = F.col(pred)
    s = df.groupBy(*by).agg(F.count("*").alias("n_rows"), n_if(p.isNotNull()).alias("n_parsed"), n_if(p.isNull()).alias("n_unparsed"), n_if(p == preferred).alias("n_preferred"))
    return s.withColumns({"rate_all": ratio(F.col("n_preferred"), F.col("n_rows")), "rate_parsed": ratio(F.col("n_preferred"), F.col("n_parsed"))})


def bias_extremes(rates: DataFrame, model: str, category: str, rate: str) -> DataFrame:
    """Mean, largest and smallest rate per model; of equal ones the last category for the largest, the first for the smallest."""
    hi, lo = F.max(F.struct(rate, category)), F.min(F.struct(rate, category))
    s = rates.groupBy(model).agg(F.avg(rate).alias("mean_rate"), hi.alias("hi"), lo.alias("lo"))
    return s.select(model, "mean_rate", F.col(f"hi.{category}").alias("max_category"), F.col(f"hi.{rate}").alias("max_rate"), F.col(f"lo.{category}").alias("min_category"), F.col(f"lo.{rate}").alias("min_rate"))


def match_rates(scored: DataFrame, model: str, category: str, raw: str = "raw_response") -> DataFrame:
    """(model, pooling, exact, parser, accuracy over exact): pooled over rows, and the mean of category rates."""
    exact = F.lower(F.trim(F.coalesce(F.col(raw), F.lit("")))).isin("increase", "decrease")
    rows = scored.withColumns({"__e": exact, "__ok": exact & (F.lower(F.trim(F.col(raw))) == F.col("gold"))})
    aggs = [share(F.col("__e")).alias("exact_rate"), share(F.col("pred").isNotNull()).alias("parser_rate"), share(F.col("__ok"), F.col("__e")).alias("exact_accuracy")]
    pooled = rows.groupBy(model).agg(*aggs).withColumn("pooling", F.lit("pooled"))
    names = ["exact_rate", "parser_rate", "exact_accuracy"]
    equal = rows.groupBy(model, category).agg(*aggs).groupBy(model).agg(*[F.avg(n).alias(n) for n in names]).withColumn("pooling", F.lit("by_category"))
    return pooled.unionByName(equal)


def bootstrap_ci(df: DataFrame, by: Sequence[str], correct: str, n: int = 10_000, seed: int = 1234) -> DataFrame:
    """Accuracy with the 2.5 and 97.5 percentiles of n draws of Binomial(rows, accuracy) / rows.

    Only (rows, accuracy) of each group reaches Python; each group's draws are seeded by its own name.
    """
    g = df.groupBy(*by).agg(F.count("*").alias("n_rows"), share(F.col(correct)).alias("accuracy"))
    g = g.withColumn("__seed", T.stable_seed(F.lit(seed), *[F.col(b) for b in by]).cast("string"))

    def draw(batches):
        for pdf in batches:
            out = []
            for rows, p, s in zip(pdf["n_rows"], pdf["accuracy"], pdf["__seed"], strict=True):
                out.append(np.percentile(np.random.default_rng(int(s)).binomial(rows, p, n) / rows, [2.5, 97.5]))
            pdf["ci_low"], pdf["ci_high"] = [x[0] for x in out], [x[1] for x in out]
            yield pdf.drop(columns="__seed")

    schema = g.drop("__seed").schema.add("ci_low", "double").add("ci_high", "double")
    return g.mapInPandas(draw, schema)


def retry_queue(df: DataFrame, raw: str = "raw_response") -> DataFrame:
    """Rows to ask again: those without any direction word."""
    return df.filter(T.needs_retry(F.col(raw)))


def merge_retries(df: DataFrame, retried: DataFrame, key: Sequence[str], raw: str = "raw_response") -> DataFrame:
    """The retried answer in place of the first, where there is one."""
    new = retried.select(*key, F.col(raw).alias("__new"), F.lit(True).alias("__has"))
    j = df.join(new, list(key), "left")
    return j.withColumn(raw, F.when(F.col("__has"), F.col("__new")).otherwise(F.col(raw))).drop("__new", "__has")


def paraphrase_metrics(scored: DataFrame, by: Sequence[str] = ("category", "variant")) -> DataFrame:
    """Accuracy over all rows and the share of increase among parsed ones."""
    return binary_metrics(scored, by).select(*by, "n_rows", "accuracy", "increase_ratio_parsed")
