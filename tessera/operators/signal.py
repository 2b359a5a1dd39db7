"""Speech bounds, condition grids, schedules and rendering of waveforms."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions import dsp
from ..functions.text import stable_seed, step_progress
from .spread import matches, ordered_places, spread_join

DOUBLES = ArrayType(DoubleType())
#: Clips in an Arrow batch: waveforms are large.
CLIP_ROWS = 64
#: Samples of batches that are rendered together where an effect takes many clips at once.
WAITING = 1 << 20

# Per category the step's parameter at either end. d stands for the tier's amount, r for the sample rate.
ENDS = {
    "volume": ("-d", "d"), "speaking_speed": ("1 - d", "1 + d"), "voice_pitch": ("-d", "d"), "background_noise": ("0", "d"),
    "audio_distortion": ("r", "d"), "audio_roughness": ("16", "d"), "voice_clarity": ("d", "r / 2"), "voice_vibration": ("0", "d"), "echo": ("0", "d"),
}


def _small_batches(df: DataFrame) -> None:
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(CLIP_ROWS))


def frame_rms(df: DataFrame, samples: str, rate: str, frame_ms: float = 25, hop_ms: float = 10, alpha: float = 0.97) -> DataFrame:
    """Adds rms, an array of one value per frame."""
    _small_batches(df)

    @F.pandas_udf("array<double>")
    def run(x: pd.Series, r: pd.Series) -> pd.Series:
        size = lambda v, ms: max(1, round(v * ms / 1000))
        return pd.Series([dsp.frame_rms(a, size(v, frame_ms), size(v, hop_ms), alpha) for a, v in zip(x, r, strict=True)])

    return df.withColumn("rms", run(samples, rate))


def speech_threshold(frames: DataFrame, head: int, clip: str = "clip", frame: str = "frame", value: str = "rms") -> DataFrame:
    """Per clip noise_floor (median of the first `head` frames), peak and threshold. frames: clip, frame from 0, rms."""
    g = frames.groupBy(clip).agg(F.percentile(F.when(F.col(frame) < head, F.col(value)), 0.5).alias("noise_floor"), F.max(value).alias("peak"))
    return g.withColumn("threshold", F.greatest(1.8 * F.col("noise_floor"), 0.003 * F.col("peak"), F.lit(5e-5)))


#: Frames of a clip that one window orders. A clip is cut at multiples of it, so its length does not matter.
SPAN = 65_536


def frames_in_order(df: DataFrame, clip: str, order: Sequence[str], frame: str = "frame") -> DataFrame:
    """Adds the number of each row within its clip, from 0, in an order that does not tie; a clip may be cut into many ranges."""
    return ordered_places(df, order, frame, [clip])


def active_segments(frames: DataFrame, min_run: int, clip: str = "clip", frame: str = "frame", active: str = "active", span: int = SPAN) -> DataFrame:
    """(clip, start, stop): runs of consecutive active frames, of `min_run` at least; stop excluded.

    Runs are found within spans of a clip. Those that touch an end of their span, two of it at most, are stitched to their
    neighbours in an order over these alone.
    """
    on = frames.filter(F.col(active)).select(clip, frame, F.floor(F.col(frame) / span).alias("__span"))
    w = Window.partitionBy(clip, "__span").orderBy(frame)
    parts = on.withColumn("__run", F.col(frame) - F.row_number().over(w)).groupBy(clip, "__span", "__run")
    parts = parts.agg(F.min(frame).alias("start"), (F.max(frame) + 1).alias("stop"))
    edge = (F.col("start") == F.col("__span") * span) | (F.col("stop") == (F.col("__span") + 1) * span)
    along = Window.partitionBy(clip).orderBy("start")
    touching = parts.filter(edge).withColumn("__new", (~F.lag("stop").over(along).eqNullSafe(F.col("start"))).cast("int"))
    whole = touching.withColumn("__chain", F.sum("__new").over(along)).groupBy(clip, "__chain").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    runs = parts.filter(~edge).select(clip, "start", "stop").union(whole.select(clip, "start", "stop"))
    return runs.filter(F.col("stop") - F.col("start") >= min_run)


def speech_bounds(frames: DataFrame, head: int, min_run: int, hop_sec: float, frame_sec: float, clip: str = "clip", frame: str = "frame", value: str = "rms") -> DataFrame:
    """Per clip: detected, onset, offset and duration in seconds, runs, and the threshold's parts; nulls where undetected."""
    t = speech_threshold(frames, head, clip, frame, value)
    marked = spread_join(frames, t.select(clip, "threshold"), [clip], F.col(frame)).withColumn("active", F.col(value) >= F.col("threshold"))
    runs = active_segments(marked, min_run, clip, frame).groupBy(clip).agg(F.min("start").alias("a"), F.max("stop").alias("b"), F.count("*").alias("n_segments"))
    j = matches(t, runs, [clip], "left")
    onset, offset = F.col("a") * hop_sec, (F.col("b") - 1) * hop_sec + frame_sec
    return j.select(
        clip, F.col("a").isNotNull().alias("detected"), onset.alias("onset_sec"), offset.alias("offset_sec"), (offset - onset).alias("duration_sec"),
        F.coalesce("n_segments", F.lit(0)).cast("long").alias("n_segments"), "noise_floor", "peak", "threshold",
    )


def bounds_summary(bounds: DataFrame) -> DataFrame:
    """(measure, n_detected, n_undetected, mean, median, min, max) of onset, offset and duration."""
    names = ("onset_sec", "offset_sec", "duration_sec")
    aggs = [F.struct(F.lit(n).alias("measure"), F.avg(n).alias("mean"), F.percentile(n, 0.5).alias("median"), F.min(n).alias("min"), F.max(n).alias("max")) for n in names]
    s = bounds.agg(F.sum(F.col("detected").cast("long")).alias("n_detected"), F.sum((~F.col("detected")).cast("long")).alias("n_undetected"), F.array(*aggs).alias("rows"))
    return s.select("n_detected", "n_undetected", F.explode("rows").alias("r")).select("r.*", "n_detected", "n_undetected")


def condition_grid(clips: DataFrame, grid: DataFrame, key: str) -> DataFrame:
    """Every clip under every condition of a small grid (category, tier, amount, curve, direction), with its id and label."""
    g = clips.crossJoin(F.broadcast(grid))
    name = F.concat_ws("__", F.col("category"), F.col(key).cast("string"), "curve", "tier", "direction")
    return g.withColumn("benchmark_clip_id", name).withColumn("label", F.when(F.col("direction") == "up", "increase").otherwise("decrease"))


def _ends(category: Column, amount: Column, rate: Column) -> tuple[Column, Column]:
    parts = {"d": amount, "-d": -amount, "0": F.lit(0.0), "1 - d": 1 - amount, "1 + d": 1 + amount, "r": rate, "r / 2": rate / 2, "16": F.lit(16.0)}
    low = high = F
    for c, (a, b) in ENDS.items():
        low, high = low.when(category == c, parts[a].cast("double")), high.when(category == c, parts[b].cast("double"))
    return low, high


def parameter_schedule(manifest: DataFrame, key: str, step_sec: float = 0.05) -> DataFrame:
    """(key, step, start, stop, value): sample ranges of the steps between onset and offset and the parameter in each.

    manifest: key, category, rate, num_samples, onset_sec, offset_sec, direction, curve, amount. Speed cuts the span into
    equal parts, the others into steps of the same length with a shorter last one. Narrow: no shuffle.
    """
    clamp = lambda t: F.least(F.col("num_samples"), F.greatest(F.lit(0), F.bround(F.col(t) * F.col("rate")).cast("int")))
    a, b = clamp("onset_sec"), clamp("offset_sec")
    m = manifest.withColumns({"a": F.when(b > a, a).otherwise(0), "b": F.when(b > a, b).otherwise(F.col("num_samples"))})
    m = m.withColumn("size", F.greatest(F.lit(1), F.bround(F.col("rate") * step_sec).cast("int")))
    m = m.withColumn("n", F.greatest(F.lit(1), F.ceil((F.col("b") - F.col("a")) / F.col("size")).cast("int")))
    low, high = _ends(F.col("category"), F.col("amount"), F.col("rate").cast("double"))
    up = F.col("direction") == "up"
    m = m.withColumns({"v0": F.when(up, low).otherwise(high), "v1": F.when(up, high).otherwise(low)})
    s = m.withColumn("step", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    cut = lambda i: F.bround(i * (F.col("b") - F.col("a")) / F.col("n")).cast("int")
    even = F.col("category") == "speaking_speed"
    start = F.col("a") + F.when(even, cut(F.col("step"))).otherwise(F.col("step") * F.col("size"))
    stop = F.when(even, F.col("a") + cut(F.col("step") + 1)).otherwise(F.least(F.col("a") + (F.col("step") + 1) * F.col("size"), F.col("b")))
    value = F.col("v0") + (F.col("v1") - F.col("v0")) * step_progress(F.col("step"), F.col("n"), F.col("curve"))
    return s.select(key, "step", start.alias("start"), stop.alias("stop"), value.alias("value"))


def render(clips: DataFrame, effect: str, key: str = "clip_id", **params) -> DataFrame:
    """(key, samples, n_samples, clipped_ratio): the effect applied to every clip.

    clips: key, samples (array of -1 to 1), rate, onset_sec, offset_sec, direction, curve, amount. Each clip is rendered by
    itself, noise from a seed that its key gives, so partitions do not matter. Repartition by key first if rows are few
    and long. effect: one of functions.dsp.EFFECTS.
    """
    _small_batches(clips)
    f = dsp.EFFECTS[effect]
    names = ["samples", "rate", "onset_sec", "offset_sec", "direction", "curve", "amount"]
    source = clips.select(key, *names, stable_seed(F.lit(effect), F.col(key)).cast("string").alias("seed"))
    schema = type(source.schema)([source.schema[key]]).add("samples", DOUBLES).add("n_samples", "long").add("clipped_ratio", "double")

    def rendered(pdf):
        rows = [(np.asarray(row[0], float), *row[1:-1], row[-1]) for row in pdf[[*names, "seed"]].itertuples(index=False)]
        if effect in dsp.EFFECTS_OF_ALL:
            out = dsp.EFFECTS_OF_ALL[effect]([row[:-1] for row in rows], **params)
        else:
            out = [f(*row[:-1], **params | ({"seed": int(row[-1])} if effect == "noise" else {})) for row in rows]
        return pd.DataFrame({key: pdf[key], "samples": out, "n_samples": [len(x) for x in out], "clipped_ratio": [float(np.mean(np.abs(x) > 1)) if len(x) else 0.0 for x in out]})

    def run(batches):
        waiting, size = [], 0
        for pdf in batches:
            waiting.append(pdf)
            size += pdf["samples"].map(len).sum()
            if size >= WAITING or effect not in dsp.EFFECTS_OF_ALL:
                yield rendered(pd.concat(waiting, ignore_index=True))
                waiting, size = [], 0
        if waiting:
            yield rendered(pd.concat(waiting, ignore_index=True))

    return source.mapInPandas(run, schema)


def clip_stats(manifest: DataFrame, keys: Sequence[str] = ("direction", "curve", "tier")) -> DataFrame:
    """(scope, key, n_rows, mean_clipped_ratio) overall and by each key, in one pass; a null key counts as `unknown`."""
    g = manifest.groupingSets([[]] + [[F.col(k)] for k in keys], *keys).agg(F.grouping_id(*keys).alias("__set"), F.count("*").alias("n_rows"), F.avg("clipped_ratio").alias("mean_clipped_ratio"))
    # a bit of the id is 0 for the column that a row is grouped by, the first column's the highest
    alone = {k: (1 << len(keys)) - 1 - (1 << (len(keys) - 1 - i)) for i, k in enumerate(keys)}
    scope = F.coalesce(*[F.when(F.col("__set") == n, F.lit(f"by_{k}")) for k, n in alone.items()], F.lit("overall"))
    key = F.coalesce(*[F.when(F.col("__set") == n, F.coalesce(F.col(k).cast("string"), F.lit("unknown"))) for k, n in alone.items()], F.lit("all"))
    return g.select(scope.alias("scope"), key.alias("key"), "n_rows", "mean_clipped_ratio")


def sine_sources(freqs: DataFrame, hz: str, rate: int = 48_000, head: float = 0.75, active: float = 2.1, tail: float = 0.75) -> DataFrame:
    """Adds samples of a tone between silent ends, and its bounds."""
    _small_batches(freqs)

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([dsp.sine(v, rate, head, active, tail) for v in x])

    n = round(active * rate)
    return freqs.withColumns({"samples": run(hz), "rate": F.lit(rate), "onset_sec": F.lit(head), "offset_sec": F.lit(head + n / rate), "detected": F.lit(True)})


def segment_mean_pool(frames: DataFrame, k: int = 16, clip: str = "clip", frame: str = "frame", value: str = "value") -> DataFrame:
    """(clip, segment, value): means of k equal segments of a clip's frames, numbered from 0; an empty segment takes the frame where it would begin.

    Long form: one row per frame, numbered from 0; each is dealt only to the segments that may hold it. Frames of a clip are
    counted and averaged where they are before they move, so a clip of any length spreads over many tasks.
    """
    sizes = frames.groupBy(clip).agg(F.count("*").alias("n"))
    low, high = F.floor(F.col(frame) * k / F.col("n")), F.least(F.floor((F.col(frame) + 1) * k / F.col("n")), F.lit(k - 1))
    t = spread_join(frames, sizes, [clip], F.col(frame)).withColumn("segment", F.explode(F.sequence(low, high)))
    a, b = F.floor(F.col("segment") * F.col("n") / k), F.floor((F.col("segment") + 1) * F.col("n") / k)
    at = F.col(frame)
    inside = F.when(b > a, (at >= a) & (at < b)).otherwise(at == F.least(a, F.col("n") - 1))
    return t.filter(inside).groupBy(clip, "segment").agg(F.avg(value).alias("value"))


def segment_pool_arrays(df: DataFrame, frames: str, k: int = 16) -> DataFrame:
    """Adds pooled: the flattened means of k segments of an array of frames."""
    _small_batches(df)

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([dsp.segment_means(np.array([list(f) for f in v], float).reshape(len(v), -1), k).ravel() for v in x])

    return df.withColumn("pooled", run(frames))


def segment_end_positions(n: Column, k: int) -> Column:
    """The last index of each of k equal segments of n positions; of an empty one where it would begin."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.greatest(F.floor((i + 1) * n / k) - 1, F.floor(i * n / k)).cast("int"))
