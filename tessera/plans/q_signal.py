"""Queries of signals and of feature vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import signal as W
from ..operators import vectors as V
from .adapters import BOUNDED, FEATURES, FRAMES, adapt, table
from .registry import query, rounded


def clips(spark, sf):
    """Waveforms: the events of a user in time order, scaled to -1 to 1 and repeated to a few hundred samples at 2 kHz.

    A clip takes a user's events from one block of 16,384 event ids, so however many a user has, no clip holds more.
    """
    e = table(spark, sf, "events").select("user_id", F.floor(F.col("event_id") / 16384).alias("block"), "ts", "event_id", "value")
    g = e.groupBy("user_id", "block").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("s"))
    x = F.transform("s", lambda r: F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r["value"] / 100.0 - 0.5)))
    x = F.flatten(F.array_repeat(x, 60))
    c = g.select((F.col("user_id") * 1048576 + F.col("block")).alias("clip_id"), "user_id", x.alias("samples"), F.lit(2000).alias("rate"))
    mode = F.element_at(F.array(*[F.lit(m) for m in ("linear", "quad_first_flat", "quad_last_flat", "jump")]), (F.col("user_id") % 4 + 1).cast("int"))
    c = c.withColumns({"onset_sec": F.lit(0.05), "offset_sec": 0.1 + F.size("samples") / 4000.0, "direction": F.when(F.col("user_id") % 2 == 0, "up").otherwise("down"), "curve": mode})
    return c.drop("user_id")


#: The same clips in DuckDB: clip_id, user_id, and samples x.
WAVES = """SELECT clip_id, user_id, flatten([v for i in range(60)]) AS x FROM (SELECT user_id * 1048576 + CAST(floor(event_id / 16384) AS BIGINT) AS clip_id, user_id,
  list(greatest(-1.0, least(1.0, value / 100.0 - 0.5)) ORDER BY ts, event_id) AS v FROM events GROUP BY 1, 2)"""


def _rendered(df):
    """Rendered clips in short: length, energy, first samples, and a sum with weights from 1 to 97 by place, which no sample escapes."""
    energy = F.aggregate("samples", F.lit(0.0), lambda a, v: a + v * v)
    weighted = F.aggregate(F.transform("samples", lambda v, i: v * (i % 97 + 1)), F.lit(0.0), lambda a, v: a + v)
    head = F.transform(F.slice("samples", 1, 8), lambda v: F.round(v, 6) + F.lit(0.0))
    return rounded(df.select("clip_id", "n_samples", F.round("clipped_ratio", 6).alias("clipped_ratio"), F.round(energy, 4).alias("energy"), F.round(weighted, 4).alias("weighted"), head.alias("head")))


@query(f"""WITH x AS (SELECT clip_id AS user_id, x FROM ({WAVES})),
  y AS (SELECT user_id, len(x) AS n, [x[i] - CASE WHEN i > 1 THEN 0.5 * x[i - 1] ELSE 0 END for i in range(1, len(x) + 1)] AS y FROM x), f AS (SELECT user_id, y, unnest(range(0, CAST(floor((greatest(n, 50) - 50) / 20) AS BIGINT) + 1)) AS k FROM y)
  SELECT user_id AS clip_id, k AS frame, round(sqrt(list_sum([a * a for a in y[k * 20 + 1:k * 20 + 50]]) / 50), 6) AS rms FROM f""")
def w1_frame_rms(spark, sf):
    r = W.frame_rms(clips(spark, sf), "samples", "rate", 25, 10, 0.5)
    return rounded(r.select("clip_id", F.posexplode("rms").alias("frame", "rms")))


def _frames(spark, sf):
    """FRAMES, its frames numbered over ranges of the written events, not in a window per clip."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("clip"), "ts", "event_id", F.col("value").alias("rms"))
    return W.frames_in_order(e, "clip", ["ts", "event_id"]).select("clip", "frame", "rms")


_TH = f"""f AS ({FRAMES}), t AS (SELECT clip, quantile_cont(rms, 0.5) FILTER (frame < 4) AS noise_floor, max(rms) AS peak FROM f GROUP BY 1), th AS (SELECT *, greatest(1.8 * noise_floor, 0.003 * peak, 5e-5) AS threshold FROM t)"""


@query(f"WITH {_TH} SELECT clip, round(noise_floor, 6) AS noise_floor, round(peak, 6) AS peak, round(threshold, 6) AS threshold FROM th")
def w2_speech_threshold(spark, sf):
    return rounded(W.speech_threshold(_frames(spark, sf), 4))


_RUN = "i AS (SELECT clip, frame, frame - row_number() OVER (PARTITION BY clip ORDER BY frame) AS g FROM {0}), s AS (SELECT clip, min(frame) AS start, max(frame) + 1 AS stop FROM i GROUP BY clip, g HAVING count(*) >= 2)"


@query(f"WITH f AS ({FRAMES}), a AS (SELECT * FROM f WHERE rms >= 40), {_RUN.format('a')} SELECT * FROM s")
def w3_active_segments(spark, sf):
    return W.active_segments(_frames(spark, sf).withColumn("active", F.col("rms") >= 40), 2)


_BOUNDS = f"""{_TH}, a AS (SELECT f.* FROM f JOIN th ON f.clip = th.clip AND rms >= threshold), {_RUN.format('a')}, r AS (SELECT clip, min(start) AS a, max(stop) AS b, count(*) AS n FROM s GROUP BY 1),
  b AS (SELECT th.clip, r.a IS NOT NULL AS detected, r.a * 0.01 AS onset_sec, (b - 1) * 0.01 + 0.025 AS offset_sec, (b - 1) * 0.01 + 0.025 - r.a * 0.01 AS duration_sec, coalesce(n, 0) AS n_segments, noise_floor, peak, threshold FROM th LEFT JOIN r ON r.clip = th.clip)"""


def _bounds(spark, sf):
    return W.speech_bounds(_frames(spark, sf), 4, 2, 0.01, 0.025)


@query(f"WITH {_BOUNDS} SELECT clip, detected, round(onset_sec, 6) AS onset_sec, round(offset_sec, 6) AS offset_sec, round(duration_sec, 6) AS duration_sec, n_segments, round(noise_floor, 6) AS noise_floor, round(peak, 6) AS peak, round(threshold, 6) AS threshold FROM b")
def w4_speech_bounds(spark, sf):
    return rounded(_bounds(spark, sf))


@query(f"WITH {_BOUNDS} " + " UNION ALL ".join(f"SELECT '{n}' AS measure, round(avg({n}), 6) AS mean, round(quantile_cont({n}, 0.5), 6) AS median, round(min({n}), 6) AS min, round(max({n}), 6) AS max, count(*) FILTER (detected) AS n_detected, count(*) FILTER (NOT detected) AS n_undetected FROM b" for n in ("onset_sec", "offset_sec", "duration_sec")))
def w5_bounds_summary(spark, sf):
    return rounded(W.bounds_summary(_bounds(spark, sf)))


_GRID = [(c, t, 6.0 * (i + 1) + 20 * j, m, d) for j, c in enumerate(("volume", "echo")) for i, t in enumerate(("low", "mid", "high")) for m in ("linear", "quad_first_flat", "quad_last_flat", "jump") for d in ("up", "down")]
_VALUES = ", ".join(str(r) for r in _GRID)


@query(f"SELECT doc_id, source, g.*, category || '__' || doc_id || '__' || curve || '__' || tier || '__' || direction AS benchmark_clip_id, CASE direction WHEN 'up' THEN 'increase' ELSE 'decrease' END AS label FROM documents, (VALUES {_VALUES}) g(category, tier, amount, curve, direction)")
def w6_condition_grid(spark, sf):
    grid = spark.createDataFrame(_GRID, "category string, tier string, amount double, curve string, direction string")
    return rounded(W.condition_grid(table(spark, sf, "documents").select("doc_id", "source"), grid, "doc_id"))


_CURVE = "CASE curve WHEN 'linear' THEN t WHEN 'quad_first_flat' THEN t * t WHEN 'quad_last_flat' THEN 1 - (1 - t) * (1 - t) ELSE CASE WHEN t < 0.5 THEN 0.0 ELSE 1.0 END END"
_LOW = "CASE category WHEN 'volume' THEN -amount WHEN 'voice_pitch' THEN -amount WHEN 'speaking_speed' THEN 1 - amount WHEN 'audio_distortion' THEN rate WHEN 'audio_roughness' THEN 16 WHEN 'voice_clarity' THEN amount ELSE 0 END"
_HIGH = "CASE category WHEN 'speaking_speed' THEN 1 + amount WHEN 'voice_clarity' THEN rate / 2 ELSE amount END"


@query(f"""WITH c AS (SELECT *, CAST(least(num_samples, greatest(0, round_even(onset_sec * rate, 0))) AS BIGINT) AS a0, CAST(least(num_samples, greatest(0, round_even(offset_sec * rate, 0))) AS BIGINT) AS b0, CAST({_LOW} AS DOUBLE) AS low, CAST({_HIGH} AS DOUBLE) AS high FROM ({BOUNDED})),
  m AS (SELECT *, CASE WHEN b0 > a0 THEN a0 ELSE 0 END AS a, CASE WHEN b0 > a0 THEN b0 ELSE num_samples END AS b, CAST(greatest(1, round_even(rate * 0.05, 0)) AS BIGINT) AS size FROM c), n AS (SELECT *, CAST(greatest(1, ceil((b - a) / size)) AS BIGINT) AS n FROM m),
  s AS (SELECT *, unnest(range(0, n)) AS step FROM n), p AS (SELECT *, CASE WHEN n <= 1 THEN 1.0 ELSE step / CAST(n - 1 AS DOUBLE) END AS t FROM s)
  SELECT clip_id, step, CAST(a + CASE category WHEN 'speaking_speed' THEN round_even(step * (b - a) / n, 0) ELSE step * size END AS BIGINT) AS start, CAST(CASE category WHEN 'speaking_speed' THEN a + round_even((step + 1) * (b - a) / n, 0) ELSE least(a + (step + 1) * size, b) END AS BIGINT) AS stop,
  round(CASE direction WHEN 'up' THEN low + (high - low) * ({_CURVE}) ELSE high + (low - high) * ({_CURVE}) END, 6) AS value FROM p""")
def w7_parameter_schedule(spark, sf):
    return rounded(W.parameter_schedule(adapt(spark, sf, BOUNDED), "clip_id"))


#: Gain in DuckDB: 12 dB in steps of 100 samples between sample 100 and the middle plus 200, or over all where that is empty.
_GAIN = f"""WITH w AS (SELECT clip_id, user_id, x, len(x) AS n, least(len(x), CAST(200 + len(x) / 2 AS BIGINT)) AS stop FROM ({WAVES})),
  s AS (SELECT *, CASE WHEN stop > 100 THEN 100 ELSE 0 END AS a, CASE WHEN stop > 100 THEN stop ELSE n END AS b, CASE user_id % 2 WHEN 0 THEN -12.0 ELSE 12.0 END AS v0 FROM w),
  k AS (SELECT *, CAST(ceil((b - a) / 100.0) AS BIGINT) AS steps FROM s),
  r AS (SELECT clip_id, user_id, n, a, b, v0, steps, unnest(range(0, n)) AS i, unnest(x) AS x FROM k),
  t AS (SELECT *, CASE WHEN i < a THEN 0.0 WHEN i >= b OR steps = 1 THEN 1.0 ELSE floor((i - a) / 100) / CAST(steps - 1 AS DOUBLE) END AS t FROM r),
  g AS (SELECT *, CASE user_id % 4 WHEN 0 THEN t WHEN 1 THEN t * t WHEN 2 THEN 1 - (1 - t) * (1 - t) ELSE CASE WHEN t >= 0.5 THEN 1.0 ELSE 0.0 END END AS p FROM t),
  y AS (SELECT clip_id, i, n, x * pow(10, (v0 - 2 * v0 * p) / 20) AS y FROM g)
  SELECT clip_id, max(n) AS n_samples, round(avg(CAST(abs(y) > 1 AS INT)), 6) AS clipped_ratio, round(sum(y * y ORDER BY i), 4) AS energy, round(sum(y * (i % 97 + 1) ORDER BY i), 4) AS weighted,
  list(round(y, 6) + 0.0 ORDER BY i) FILTER (i < 8) AS head FROM y GROUP BY 1"""


def _effect(number, name, amount, sql=None, **params):
    def run(spark, sf):
        return _rendered(W.render(clips(spark, sf).withColumn("amount", F.lit(float(amount))), name, **params))

    run.__name__ = f"w{number}_{name}"
    return query(sql)(run)


_effect(8, "gain", 12, _GAIN)
_effect(9, "noise", 0.07)
_effect(10, "sample_hold", 1000)
_effect(11, "quantize", 6)
_effect(12, "tremolo", 0.75)
_effect(13, "reverb", 0.4)
_effect(14, "lowpass", 300)


@query(f"WITH b AS ({BOUNDED}) SELECT 'overall' AS scope, 'all' AS key, count(*) AS n_rows, round(avg(clipped_ratio), 6) AS mean_clipped_ratio FROM b " + " ".join(f"UNION ALL SELECT 'by_{k}', {k}, count(*), round(avg(clipped_ratio), 6) FROM b GROUP BY {k}" for k in ("direction", "curve", "tier")))
def w15_clip_stats(spark, sf):
    return rounded(W.clip_stats(adapt(spark, sf, BOUNDED)))


_SOME = f"SELECT CASE WHEN clip_id % 5 > 0 THEN direction END AS direction, CASE WHEN clip_id % 7 > 0 THEN curve END AS curve, tier, clipped_ratio FROM ({BOUNDED})"


@query(f"WITH b AS ({_SOME}) SELECT 'overall' AS scope, 'all' AS key, count(*) AS n_rows, round(avg(clipped_ratio), 6) AS mean_clipped_ratio FROM b " + " ".join(f"UNION ALL SELECT 'by_{k}', coalesce({k}, 'unknown'), count(*), round(avg(clipped_ratio), 6) FROM b GROUP BY {k}" for k in ("direction", "curve", "tier")))
def w15_clip_stats_unknown(spark, sf):
    """Clips of which some lack a direction or a curve."""
    return rounded(W.clip_stats(adapt(spark, sf, _SOME)))


@query()
def w16_sine_sources(spark, sf):
    f = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("clip_id"), (700.0 + F.col("s_suppkey") % 10 * 150).alias("hz"))
    s = W.sine_sources(f, "hz", 8000)
    energy = F.aggregate("samples", F.lit(0.0), lambda a, v: a + v * v)
    return rounded(s.select("clip_id", "hz", F.size("samples").alias("n_samples"), energy.alias("energy"), "onset_sec", "offset_sec"))


@query(f"""WITH f AS (SELECT *, count(*) OVER (PARTITION BY clip) AS n FROM ({FRAMES})), s AS (SELECT f.*, k, CAST(floor(k * n / 16) AS BIGINT) AS a, CAST(floor((k + 1) * n / 16) AS BIGINT) AS b FROM f, range(16) r(k))
  SELECT clip, k AS segment, round(avg(rms), 6) AS value FROM s WHERE CASE WHEN b > a THEN frame >= a AND frame < b ELSE frame = least(a, n - 1) END GROUP BY 1, 2""")
def w17_segment_mean_pool(spark, sf):
    return rounded(W.segment_mean_pool(_frames(spark, sf), 16, value="rms"))


@query(f"""WITH f AS (SELECT *, count(*) OVER (PARTITION BY clip) AS n FROM ({FRAMES})), s AS (SELECT f.*, k, CAST(floor(k * n / 4) AS BIGINT) AS a, CAST(floor((k + 1) * n / 4) AS BIGINT) AS b FROM f, range(4) r(k))
  SELECT clip, k AS segment, round(avg(rms), 6) AS value FROM s WHERE CASE WHEN b > a THEN frame >= a AND frame < b ELSE frame = least(a, n - 1) END GROUP BY 1, 2""")
def w17_segment_pool_arrays(spark, sf):
    a = _frames(spark, sf).groupBy("clip").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "rms"))), lambda x: F.array(x["rms"])).alias("frames"))
    return rounded(W.segment_pool_arrays(a, "frames", 4).select("clip", F.posexplode("pooled").alias("segment", "value")))


@query("SELECT user_id, k AS segment, CAST(greatest(floor((k + 1) * n / 5) - 1, floor(k * n / 5)) AS BIGINT) AS position FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1), range(5) r(k)")
def w18_segment_end_positions(spark, sf):
    n = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return rounded(n.select("user_id", F.posexplode(W.segment_end_positions(F.col("n"), 5)).alias("segment", "position")))


_P = f"f AS ({FEATURES}), p AS (SELECT u.model, u.category, u.source, u.pair, [CAST(u.vec[i] AS DOUBLE) - CAST(d.vec[i] AS DOUBLE) for i in range(1, 65)] AS diff FROM f u JOIN f d ON u.pair = d.pair AND u.direction = 'up' AND d.direction = 'down')"
_M = f"{_P}, e AS (SELECT model, category, source, unnest(range(0, 64)) AS i, unnest(diff) AS x FROM p), g AS (SELECT model, category, source, i, avg(x) AS x FROM e GROUP BY ALL), d AS (SELECT model, category, i, avg(x) AS x FROM g GROUP BY ALL)"


def _pairs(spark, sf):
    f = adapt(spark, sf, FEATURES)
    whole = f.groupBy("pair").agg(F.count("*").alias("n")).filter("n = 2").select("pair")
    return V.pair_directions(f.join(whole, "pair", "left_semi"), ["model", "category", "source", "pair"])


@query(f"WITH {_P} SELECT model, category, source, pair, round(diff[1], 6) AS first, round(list_sum([x * x for x in diff]), 5) AS energy FROM p")
def v1_pair_directions(spark, sf):
    p = _pairs(spark, sf).select("model", "category", "source", "pair", F.col("diff")[0].alias("first"), F.round(V.dot(F.col("diff"), F.col("diff")), 5).alias("energy"))
    return rounded(p)


@query(f"WITH {_M} SELECT model, category, i, round(x, 6) AS x FROM d")
def v2_source_directions(spark, sf):
    return rounded(V.source_directions(_pairs(spark, sf), ["model", "category"], "source").select("model", "category", F.posexplode("vec").alias("i", "x")))


_C = f"{_M}, c AS (SELECT x.model, x.category AS a, y.category AS b, sum(x.x * y.x) / (sqrt(sum(x.x * x.x)) * sqrt(sum(y.x * y.x))) AS cosine FROM d x JOIN d y ON x.model = y.model AND x.i = y.i GROUP BY ALL)"


def _cosines(spark, sf, base=None):
    return V.cosine_matrix(V.source_directions(_pairs(spark, sf), ["model", "category"], "source"), ["model"], "category", base=base)


@query(f"WITH {_C} SELECT c.model, c.a, c.b, round(c.cosine, 6) + 0.0 AS cosine, round(c.cosine - z.cosine, 6) + 0.0 AS delta FROM c JOIN c z ON z.model = 0 AND z.a = c.a AND z.b = c.b")
def v3_cosine_matrix(spark, sf):
    return rounded(_cosines(spark, sf, 0))


@query(f"WITH {_C} SELECT model, round(avg(cosine), 6) AS mean_cosine, round(avg(abs(cosine)), 6) AS mean_abs_cosine, count(*) AS n_pairs FROM c WHERE a < b GROUP BY 1")
def v4_alignment_summary(spark, sf):
    return rounded(V.alignment_summary(_cosines(spark, sf), ["model"]))


_SETS = f"SELECT model, category, pair * 2 + 1 - gold AS cid, gold, vec FROM ({FEATURES})"


@query(f"""WITH f AS (SELECT model, category, CASE WHEN category = 1 THEN clip_id ELSE clip_id % 6 END AS c, gold FROM ({FEATURES})), g AS (SELECT model, category, list(c || '' ORDER BY c || '', gold || '') AS ids, list(c || '=' || gold ORDER BY c || '', gold || '') AS labels FROM f WHERE clip_id IS NOT NULL GROUP BY 1, 2)
  SELECT g.model, g.category, g.ids IS NOT DISTINCT FROM b.ids AS same_ids, g.labels IS NOT DISTINCT FROM b.labels AS same_labels, true AS same_shape, true AS finite FROM g LEFT JOIN g b ON b.model = 0 AND b.category = g.category""".replace("CASE WHEN category = 1 THEN clip_id ELSE clip_id % 6 END AS c, gold", "CASE WHEN category = 1 THEN clip_id ELSE CAST(floor(clip_id / 24) AS BIGINT) END AS c, gold, clip_id"))
def v5_check_feature_sets(spark, sf):
    f = adapt(spark, sf, FEATURES).withColumn("c", F.when(F.col("category") == 1, F.col("clip_id")).otherwise(F.floor(F.col("clip_id") / 24)))
    return V.check_feature_sets(f, "model", "category", "c", "gold", 0)


_PROMPTED = f"SELECT model, category, pair * 2 + 1 - gold AS cid, gold, vec, CASE WHEN model = 2 AND pair % 24 = 20 THEN 'How?' ELSE 'Which way?' END AS prompt, CASE WHEN model = 1 THEN source % 4 ELSE source END AS source FROM ({FEATURES})"


@query(f"""WITH f AS ({_PROMPTED}), g AS (SELECT model, category, list(cid ORDER BY cid) AS ids, list(cid || '=' || gold ORDER BY cid) AS labels, list(cid || '=' || prompt ORDER BY cid) AS prompts, list_sort(list(DISTINCT source)) AS sources FROM f GROUP BY 1, 2),
  s AS (SELECT sources FROM g WHERE model = 0 ORDER BY category LIMIT 1)
  SELECT g.model, g.category, g.ids IS NOT DISTINCT FROM b.ids AS same_ids, g.labels IS NOT DISTINCT FROM b.labels AS same_labels, g.prompts IS NOT DISTINCT FROM b.prompts AS same_prompts, true AS same_shape, true AS finite, g.sources = s.sources AS same_sources
  FROM g LEFT JOIN g b ON b.model = 0 AND b.category = g.category CROSS JOIN s""")
def v5_prompts_and_sources(spark, sf):
    return V.check_feature_sets(adapt(spark, sf, _PROMPTED), "model", "category", "cid", "gold", 0, prompt="prompt", source="source")


@query(f"WITH e AS (SELECT model, unnest(range(0, 64)) AS i, unnest([CAST(x AS DOUBLE) for x in vec]) AS x FROM ({FEATURES})) SELECT model, i, round(avg(x), 6) AS mean, round(CASE WHEN stddev_pop(x) < 1e-6 THEN 1.0 ELSE stddev_pop(x) END, 6) AS std FROM e GROUP BY 1, 2")
def v6_standardize(spark, sf):
    s = V.standardize(adapt(spark, sf, FEATURES), ["model"])
    return rounded(s.select("model", F.posexplode(F.arrays_zip("mean", "std")).alias("i", "z")).select("model", "i", "z.mean", "z.std"))


@query()
def v7_train_probes(spark, sf):
    """Probes on four of five sources; v7_held_out scores the fifth. No SQL: the fit is iterative, tested against a plain one."""
    p = V.train_probes(adapt(spark, sf, FEATURES).filter("source <> 0"), ["model", "category"])
    return rounded(p.select("model", "category", "n_train", "bias", "loss", F.col("weights")[0].alias("first_weight")))


@query()
def v7_held_out(spark, sf):
    f = adapt(spark, sf, FEATURES)
    probes = V.train_probes(f.filter("source <> 0"), ["model", "category"])
    return rounded(V.score_probes(f.filter("source = 0"), probes, ["model", "category"]))


@query(f"""WITH s AS (SELECT model, category, gold, CASE WHEN (CAST(vec[1] AS DOUBLE) - 0.1) / 0.5 * 2.0 - (CAST(vec[2] AS DOUBLE) - 0.1) / 0.5 + 0.25 >= 0 THEN 1 ELSE 0 END AS pred FROM ({FEATURES})),
  g AS (SELECT model, category, count(*) AS n_test, avg(CAST(pred = gold AS INT)) AS a, avg(CAST(pred = gold AS INT)) FILTER (gold = 1) AS u, avg(CAST(pred = gold AS INT)) FILTER (gold = 0) AS d FROM s GROUP BY 1, 2)
  SELECT model, category, n_test, round(a, 6) AS accuracy, round(u, 6) AS accuracy_up, round(d, 6) AS accuracy_down, round(list_avg([u, d]), 6) AS balanced_accuracy FROM g""")
def v8_score_probes(spark, sf):
    f = adapt(spark, sf, FEATURES)
    flat = lambda first, second, rest: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(i == 0, float(first)).when(i == 1, float(second)).otherwise(float(rest)))
    p = f.select("model", "category").distinct().withColumns({"weights": flat(2, -1, 0), "bias": F.lit(0.25), "mean": flat(0.1, 0.1, 0), "std": flat(0.5, 0.5, 1)})
    return rounded(V.score_probes(f, p, ["model", "category"]))


@query("SELECT label % 3 AS model, round(avg(v), 6) AS value, count(*) AS n_categories FROM (SELECT label, CASE WHEN label <> 4 THEN avg(CAST(embedding[1] AS DOUBLE)) END AS v FROM embeddings GROUP BY 1) GROUP BY 1")
def v9_mean_over_categories(spark, sf):
    p = table(spark, sf, "embeddings").groupBy("label").agg(F.avg(F.col("embedding")[0].cast("double")).alias("v"))
    p = p.select((F.col("label") % 3).alias("model"), F.when(F.col("label") != 4, F.col("v")).alias("value"))
    return rounded(V.mean_over_categories(p, ["model"], ["value"]))
