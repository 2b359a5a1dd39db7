import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import dsp
from tessera.operators import signal as W
from tessera.operators import vectors as V

rng = np.random.default_rng(3)
X = rng.uniform(-0.8, 0.8, 4000)
MODES = ("linear", "quad_first_flat", "quad_last_flat", "jump")


def curve(t, mode):
    return {"linear": t, "quad_first_flat": t * t, "quad_last_flat": 1 - (1 - t) ** 2, "jump": float(t >= 0.5)}[mode]


@pytest.mark.parametrize("mode", MODES)
def test_gain_sample_by_sample(mode):
    got = dsp.gain(X, 8000, 0.1, 0.35, "up", mode, 12)
    n = math.ceil(2000 / 400)
    for i in range(0, 4000, 37):
        k = 0 if i < 800 else (i - 800) // 400
        p = 0.0 if i < 800 else 1.0 if i >= 2800 else curve(k / (n - 1), mode)
        assert math.isclose(got[i], X[i] * 10 ** ((-12 + 24 * p) / 20), rel_tol=1e-9)


def test_bounds_fall_back_to_the_whole_clip():
    assert dsp.span(100, 10, 5, 5) == (0, 100) and dsp.span(100, 10, -1, 99) == (0, 100) and dsp.span(100, 10, 1.25, 3) == (12, 30)


def test_noise_follows_ratio_and_seed():
    a, b = (dsp.noise(X, 8000, 0.1, 0.4, "down", "linear", 0.1, seed=5) for _ in range(2))
    assert (a == b).all() and (a != dsp.noise(X, 8000, 0.1, 0.4, "down", "linear", 0.1, seed=6)).any()
    d = a - X
    assert np.allclose(d[3300:], 0) and math.isclose(dsp.rms(d[:800]) / dsp.rms(X[800:3200]), 0.1, rel_tol=0.1)


def test_hold_and_quantize():
    h = dsp.hold(X[:10], 8000, 4000)
    assert np.allclose(h[::2], h[1::2]) and math.isclose(dsp.rms(h), dsp.rms(X[:10]))
    q = dsp.quantized(X, 4)
    assert len(np.unique(np.round(q, 9))) <= 15 and math.isclose(dsp.rms(q), dsp.rms(X))
    assert np.allclose(dsp.quantize(X, 8000, 0.1, 0.4, "up", "jump", 4)[:700], dsp.quantized(X[:800], 16)[:700])


def test_joined_pieces_lose_only_the_fades():
    parts = [np.full(10, v) for v in (1.0, 2.0, 3.0)]
    out = dsp.joined(parts, 4)
    assert len(out) == 22 and np.allclose(out[:6], 1) and np.allclose(out[6:10], np.linspace(1, 2, 4)) and np.allclose(out[-6:], 3)
    assert len(dsp.sample_hold(X, 8000, 0.1, 0.35, "up", "linear", 2000)) == 4000 - 4 * 40


def test_tremolo_against_a_loop():
    got, phase = dsp.tremolo(X, 8000, 0.1, 0.4, "up", "linear", 0.6), 0.0
    for i in range(4000):
        t = 0.0 if i < 800 else 1.0 if i >= 3200 else (i - 800) / 2399
        if i % 97 == 0:
            assert math.isclose(got[i], X[i] * (1 - 0.6 * t * 0.5 * (1 + math.sin(phase))), abs_tol=1e-9)
        phase += 2 * math.pi * 20 * t / 8000


def test_impulse_response_against_the_recurrences():
    rate, room = 1000, 0.8
    n = 300
    x = np.zeros(n)
    x[0] = 1
    combs = []
    for ms, g in zip(dsp.COMB_MS, dsp.COMB_GAIN, strict=True):
        d, y = max(1, round(ms / 1000 * rate)), np.zeros(n)
        for i in range(n):
            y[i] = x[i] + (g * room * y[i - d] if i >= d else 0)
        combs.append(y)
    s = np.mean(combs, axis=0)
    for ms, g in zip(dsp.ALLPASS_MS, dsp.ALLPASS_GAIN, strict=True):
        d, y = max(1, round(ms / 1000 * rate)), np.zeros(n)
        for i in range(n):
            y[i] = -g * room * s[i] + ((s[i - d] + g * room * y[i - d]) if i >= d else 0)
        s = y
    assert np.allclose(dsp.impulse_response(rate, room)[:n], s)
    assert np.allclose(dsp.convolved(X, np.array([0, 1.0])), np.concatenate([[0], X[:-1]]))


@pytest.mark.parametrize("n", [1, 3, 100, 511, 4000])
def test_lowpass_reconstructs_and_attenuates(n):
    x = X[:n]
    assert np.allclose(dsp.masked(x, lambda k: np.ones(k // 2 + 1)), x, atol=1e-9)
    if n == 4000:
        t = np.arange(n) / 8000
        y = dsp.masked(np.sin(2 * np.pi * 300 * t) + np.sin(2 * np.pi * 3000 * t), lambda k: dsp.lowpass_mask(np.fft.rfftfreq(k, 1 / 8000), 1500, 800))
        assert np.allclose(y[600:-600], np.sin(2 * np.pi * 300 * t)[600:-600], atol=0.02)


def test_frame_rms_and_pooling():
    x = X[:130]
    y = np.concatenate([x[:1], x[1:] - 0.97 * x[:-1]])
    want = [math.sqrt(np.mean(y[a : a + 50] ** 2)) for a in range(0, 81, 20)]
    assert np.allclose(dsp.frame_rms(x, 50, 20, 0.97), want) and len(dsp.frame_rms(X[:3], 50, 20)) == 1 and len(dsp.frame_rms([], 5, 2)) == 0
    f = np.arange(5, dtype=float)[:, None]
    assert dsp.segment_means(f, 8).ravel().tolist() == [0, 0, 1, 1, 2, 3, 3, 4] and dsp.segment_means(np.zeros((0, 2)), 3).tolist() == [[0, 0]] * 3


def test_render_does_not_depend_on_partitions(spark):
    c = spark.range(20).select(F.col("id").alias("clip_id"), F.transform(F.sequence(F.lit(0), F.lit(300)), lambda i: F.sin(i * (F.col("id") + 1) / 7.0) / 2).alias("samples"))
    c = c.withColumns({"rate": F.lit(1000), "onset_sec": F.lit(0.05), "offset_sec": F.lit(0.2), "direction": F.lit("up"), "curve": F.lit("linear"), "amount": F.lit(0.1)})
    a, b = (sorted((r.clip_id, r.samples) for r in W.render(c.repartition(n), "noise").collect()) for n in (1, 7))
    assert a == b


def test_undetected_clip(spark):
    frames = spark.createDataFrame([(1, i, 0.01) for i in range(5)] + [(2, i, v) for i, v in enumerate([0.01, 0.01, 0.9, 0.9, 0.01])], "clip int, frame int, rms double")
    r = {x.clip: x for x in W.speech_bounds(frames, 2, 2, 0.01, 0.025).collect()}
    assert not r[1].detected and r[1].onset_sec is None and r[1].n_segments == 0
    assert r[2].detected and math.isclose(r[2].onset_sec, 0.02) and math.isclose(r[2].offset_sec, 0.055)


def test_vectors(spark):
    x = rng.normal(size=(40, 5))
    rows = [(i // 2 % 3, i // 2, "up" if i % 2 == 0 else "down", 1 - i % 2, x[i].tolist()) for i in range(40)]
    f = spark.createDataFrame(rows, "source int, pair int, direction string, gold int, vec array<double>")
    p = V.pair_directions(f.repartition(3), ["source", "pair"])
    d = V.source_directions(p.withColumn("g", F.lit(0)), ["g"], "source").first().vec
    diff = x[::2] - x[1::2]
    assert np.allclose(d, np.mean([diff[np.arange(20) % 3 == s].mean(axis=0) for s in range(3)], axis=0))
    with pytest.raises(Exception, match="incomplete"):
        V.pair_directions(f.filter("pair <> 3 or direction = 'up'"), ["source", "pair"]).collect()
    c = V.cosine_matrix(spark.createDataFrame([(0, "a", [1.0, 0.0]), (0, "b", [1.0, 1.0]), (0, "z", [0.0, 0.0])], "g int, k string, vec array<double>"), ["g"], "k")
    got = {(r.a, r.b): r.cosine for r in c.collect()}
    assert math.isclose(got["a", "b"], 0.5**0.5) and got["a", "z"] is None


def newton(x, y, decay):
    """The minimum in one place, from the whole group: weights, bias and loss."""
    mean, std = x.mean(axis=0), x.std(axis=0)
    z, w = np.column_stack([(x - mean) / np.where(std < 1e-6, 1, std), np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    loss = lambda w: np.mean(np.logaddexp(0, z @ w) - y * (z @ w)) + decay / 2 * w @ w
    for _ in range(300):
        p = 1 / (1 + np.exp(-(z @ w)))
        move = np.linalg.solve((z.T * (p * (1 - p))) @ z / len(x) + decay * np.eye(len(w)), z.T @ (p - y) / len(x) + decay * w)
        rate = 1.0
        while loss(w - rate * move) > loss(w) and rate > 1e-9:
            rate /= 2
        w = w - rate * move
    return w, loss(w)


def test_probes_equal_a_fit_in_one_place(spark, monkeypatch):
    x = rng.normal(size=(600, 4)) * [1, 5, 0.1, 1] + [3, 0, 0, 1]
    y = (x[:, 0] - x[:, 1] + rng.normal(size=600) > 3).astype(int)
    x[:, 3] = 2.5  # no spread
    groups = {"m": slice(0, 400), None: slice(400, 560), "apart": slice(560, 600)}
    sep = x[groups["apart"]]
    y[groups["apart"]] = sep[:, 0] > np.median(sep[:, 0])  # can be told apart without error
    rows = [(i, g, int(y[i]), x[i].tolist()) for g, s in groups.items() for i in range(600)[s]]
    odd = [(601, "m", None, [0.0] * 4), (602, "m", 1, None), (603, "m", 1, [float("nan")] * 4), (604, "m", 1, [])]
    f = spark.createDataFrame(rows + odd, "clip_id int, model string, gold int, vec array<double>")
    for parts, size in ((1, V.FIT_BYTES), (3, 1)):  # side by side, and one after the other
        monkeypatch.setattr(V, "FIT_BYTES", size)
        got = {r.model: r for r in V.train_probes(f.repartition(parts), ["model"]).collect()}
        assert set(got) == set(groups)
        for g, s in groups.items():
            w, loss = newton(x[s], y[s], 1e-4)
            assert np.abs(np.r_[got[g].weights, got[g].bias] - w).max() < 1e-6 and abs(got[g].loss - loss) < 1e-9 and got[g].n_train == len(x[s])
    assert V.train_probes(f.filter("clip_id > 600"), ["model"]).count() == 0
    m = V.score_probes(f.filter("clip_id < 400"), V.train_probes(f, ["model"]), ["model"]).first()
    assert m.accuracy > 0.85 and m.balanced_accuracy == (m.accuracy_up + m.accuracy_down) / 2


def test_the_probe_queries_against_loops(spark, sf_check):
    from tessera.plans import catalog

    rows = spark.read.parquet(f"{sf_check}/embeddings.parquet").collect()
    own = {}
    for r in rows:
        own.setdefault((r.vec_id // 2 % 3, r.vec_id // 6 % 4), []).append((r.vec_id // 24 % 5 == 0, 1 - r.vec_id % 2, r.embedding))
    got = {(r.model, r.category): r for r in catalog.queries()["v7_train_probes"](spark, sf_check).collect()}
    held = {(r.model, r.category): r for r in catalog.queries()["v7_held_out"](spark, sf_check).collect()}
    assert set(got) == set(own)
    for g, all_rows in own.items():
        x, y = (np.array([r[i] for r in all_rows if not r[0]], float) for i in (2, 1))
        w, loss = newton(x, y, 1e-4)
        assert got[g].n_train == len(x) and abs(got[g].loss - loss) < 2e-6 and abs(got[g].bias - w[-1]) < 2e-6 and abs(got[g].first_weight - w[0]) < 2e-6
        std = np.where(x.std(axis=0) < 1e-6, 1, x.std(axis=0))
        test = [(np.array(v, float), y) for out, y, v in all_rows if out]
        right = [int((((v - x.mean(axis=0)) / std) @ w[:-1] + w[-1] >= 0) == bool(y)) for v, y in test]
        assert held[g].n_test == len(test) and abs(held[g].accuracy - np.mean(right)) < 2e-6


def test_lowpass_of_many_clips_is_that_of_each(spark):
    """Clips of several lengths, rates, spans, curves and directions, some silent or empty, in any batches; few calls for those alike."""
    rng, clips = np.random.default_rng(5), []
    for i in range(400):
        n = int(rng.choice([0, 1, 3, 60, 300, 660]))
        x = rng.uniform(-1, 1, n) * (i % 7 > 0)
        clips.append((i, x, int(rng.choice([2000, 8000])), 0.05, float(rng.choice([0.02, 0.1 + n / 4000])), str(rng.choice(["up", "down"])), str(rng.choice(MODES)), float(rng.choice([300, 700]))))
    want = {}
    for k, x, rate, onset, offset, direction, mode, amount in clips:
        ends = (amount, rate / 2) if direction == "up" else (rate / 2, amount)
        want[k] = dsp.by_steps(x, rate, onset, offset, *ends, mode, lambda s, v, rate=rate: dsp.match_rms(s, dsp.masked(s, lambda m: dsp.lowpass_mask(np.fft.rfftfreq(m, 1 / rate), v, 800.0))))
    calls = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(dsp, "masked", lambda *a, whole=dsp.masked: calls.append(1) or whole(*a))
        got = dsp.lowpass_all([c[1:] for c in clips])
    assert all(np.array_equal(g, want[c[0]]) for g, c in zip(got, clips, strict=True)) and len(calls) < 400
    df = spark.createDataFrame([(k, x.tolist(), *rest) for k, x, *rest in clips], "clip_id long, samples array<double>, rate int, onset_sec double, offset_sec double, direction string, curve string, amount double")
    for parts in (1, 9):
        assert all(np.array_equal(r.samples, want[r.clip_id]) for r in W.render(df.repartition(parts), "lowpass").collect())
    assert W.render(df.limit(0), "lowpass").count() == 0
