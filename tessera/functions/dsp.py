"""Numpy helpers over one clip's samples; operators.signal runs them inside Spark tasks, a few clips a batch."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

# The delays and feedbacks of the reverberator.
COMB_MS, COMB_GAIN = (29.7, 37.1, 41.1, 43.7), (0.805, 0.827, 0.783, 0.764)
ALLPASS_MS, ALLPASS_GAIN = (5.0, 1.7), (0.7, 0.7)

#: Samples of clips of one length that are filtered as one array.
ROW_SAMPLES = 1 << 17


def span(n: int, rate: float, onset: float, offset: float) -> tuple[int, int]:
    """The samples between two times, half-even rounded and clamped; all of them if that is empty."""
    a, b = (min(n, max(0, round(t * rate))) for t in (onset, offset))
    return (a, b) if b > a else (0, n)


def progress(t, mode: str, jump_at: float = 0.5):
    t = np.asarray(t, float)
    if mode == "linear":
        return t
    if mode == "quad_first_flat":
        return t * t
    if mode == "quad_last_flat":
        return 1 - (1 - t) ** 2
    if mode == "jump":
        return (t >= jump_at).astype(float)
    raise ValueError(f"unknown curve mode: {mode}")


def step_values(n: int, start: float, end: float, mode: str, jump_at: float = 0.5) -> np.ndarray:
    """The parameter at each of n steps; a single one is the end."""
    t = np.arange(n) / (n - 1) if n > 1 else np.ones(1)
    return start + (end - start) * progress(t, mode, jump_at)


def stepped(n: int, at: tuple[int, int], size: int, start: float, end: float, mode: str, jump_at: float = 0.5) -> np.ndarray:
    """A value per sample: held before the span and after it, in steps within."""
    a, b = at
    values = step_values(max(1, math.ceil((b - a) / size)), start, end, mode, jump_at)
    out = np.full(n, float(start))
    out[a:b] = values[np.arange(b - a) // size]
    out[b:] = end
    return out


def ramp(n: int, at: tuple[int, int], start: float, end: float, mode: str, jump_at: float = 0.5) -> np.ndarray:
    """A value per sample that moves at every sample of the span."""
    a, b = at
    out = np.full(n, float(start))
    out[a:b] = step_values(b - a, start, end, mode, jump_at)
    out[b:] = end
    return out


def rms(x: np.ndarray) -> float:
    return float(np.sqrt(np.mean(np.square(x, dtype=np.float64)))) if len(x) else 0.0


def match_rms(reference: np.ndarray, x: np.ndarray) -> np.ndarray:
    a, b = rms(reference), rms(x)
    return x * (a / b) if a > 0 and b > 0 else x


def frame_rms(x: np.ndarray, frame: int, hop: int, alpha: float = 0.0) -> np.ndarray:
    """RMS of overlapping frames after pre-emphasis; a short clip is padded with zeros, the tail is left out."""
    x = np.asarray(x, float)
    if not len(x):
        return np.zeros(0)
    if alpha > 0:
        x = np.concatenate([x[:1], x[1:] - alpha * x[:-1]])
    x = np.pad(x, (0, max(0, frame - len(x))))
    return np.sqrt((np.lib.stride_tricks.sliding_window_view(x, frame)[::hop] ** 2).mean(axis=1))


def joined(pieces: list[np.ndarray], fade: int) -> np.ndarray:
    """The pieces one after another, each faded into the one before over at most `fade` samples. Pieces: samples, or rows of them."""
    out, end = np.zeros((*pieces[0].shape[:-1], sum(p.shape[-1] for p in pieces))), 0
    for p in pieces:
        size = p.shape[-1]
        n = min(fade, end, size) if end else 0
        if n:
            down = np.linspace(1.0, 0.0, n)
            out[..., end - n : end] = out[..., end - n : end] * down + p[..., :n] * (1 - down)
        out[..., end : end + size - n] = p[..., n:]
        end += size - n
    return out[..., :end]


def by_steps(x, rate, onset, offset, start, end, mode, transform, step_sec=0.05, context_sec=0.05, fade_sec=0.005, jump_at=0.5) -> np.ndarray:
    """transform(segment, value) before, in steps within, and after the span; steps see context around and are cross-faded.

    x: samples; or rows of them, with start, end and mode for each, and a value for each row of a segment.
    """
    k = x.shape[-1]
    a, b = span(k, rate, onset, offset)
    size, context, fade = max(1, round(rate * step_sec)), round(rate * context_sec), round(rate * fade_sec)
    inner = x[..., a:b]
    n = max(1, math.ceil((b - a) / size))
    values = step_values(n, start, end, mode, jump_at) if x.ndim == 1 else np.stack([step_values(n, *how, jump_at) for how in zip(start, end, mode, strict=True)], axis=-1)
    pieces = []
    for i, v in enumerate(values):
        lo, hi = i * size, min(b - a, (i + 1) * size)
        from_ = max(0, lo - context)
        pieces.append(transform(inner[..., from_ : min(b - a, hi + context)], v)[..., lo - from_ : hi - from_])
    return np.concatenate([transform(x[..., :a], start), joined(pieces, fade), transform(x[..., b:], end)], axis=-1)


def gain(x, rate, onset, offset, direction, mode, amount, step_sec=0.05) -> np.ndarray:
    """From -amount to +amount decibels upward, the other way downward."""
    start = -amount if direction == "up" else amount
    db = stepped(len(x), span(len(x), rate, onset, offset), max(1, round(rate * step_sec)), start, -start, mode)
    return x * 10 ** (db / 20)


def _rising(direction: str, low: float, high: float) -> tuple[float, float]:
    return (low, high) if direction == "up" else (high, low)


def noise(x, rate, onset, offset, direction, mode, amount, seed: int, step_sec=0.05) -> np.ndarray:
    """Gaussian noise of unit RMS, scaled by the span's RMS and a ratio that goes from or to 0."""
    at = span(len(x), rate, onset, offset)
    ratio = stepped(len(x), at, max(1, round(rate * step_sec)), *_rising(direction, 0.0, amount), mode)
    raw = np.random.default_rng(seed).standard_normal(len(x))
    return x + raw / max(rms(raw), 1e-6) * max(rms(x[at[0] : at[1]]), 1e-6) * ratio


def hold(x: np.ndarray, rate: float, effective: float) -> np.ndarray:
    """Every k-th sample held for k samples, RMS kept; k follows from the effective rate."""
    effective = max(1000, min(rate, round(effective)))
    k = max(1, round(rate / effective))
    return x.copy() if effective == rate or not len(x) else match_rms(x, x[np.arange(len(x)) // k * k])


def sample_hold(x, rate, onset, offset, direction, mode, amount) -> np.ndarray:
    start, end = _rising(direction, rate, amount)
    return by_steps(x, rate, onset, offset, start, end, mode, lambda s, v: hold(s, rate, v))


def quantized(x: np.ndarray, bits: float) -> np.ndarray:
    """Rounded to a symmetric grid of so many bits, RMS kept."""
    top = 2 ** (max(2, round(bits)) - 1) - 1
    return match_rms(x, np.round(np.clip(x, -1, 1) * top) / top)


def quantize(x, rate, onset, offset, direction, mode, amount, source_bits: int = 16) -> np.ndarray:
    start, end = _rising(direction, source_bits, amount)
    return by_steps(x, rate, onset, offset, start, end, mode, quantized)


def tremolo(x, rate, onset, offset, direction, mode, amount, hz: float = 20.0, phase: float = 0.0) -> np.ndarray:
    """Amplitude modulation whose depth and rate both go from or to 0."""
    at = span(len(x), rate, onset, offset)
    depth = ramp(len(x), at, *_rising(direction, 0.0, amount), mode)
    turn = 2 * np.pi * ramp(len(x), at, *_rising(direction, 0.0, hz), mode) / rate
    lfo = np.sin(phase + np.concatenate([[0.0], np.cumsum(turn[:-1])])) if len(x) else turn
    return x * (1 - depth * 0.5 * (1 + lfo))


@lru_cache(maxsize=32)
def impulse_response(rate: int, room: float, seconds: float = 1.5) -> np.ndarray:
    """Of four parallel comb filters, then two all-pass filters; their feedbacks scale with the room.

    A comb answers with powers of its feedback at multiples of its delay. An all-pass output depends on the outputs one
    delay earlier, so it is computed a delay's worth of samples at a time.
    """
    n = max(1, round(seconds * rate))
    y = np.zeros(n)
    for ms, g in zip(COMB_MS, COMB_GAIN, strict=True):
        delay = max(1, round(ms / 1000 * rate))
        y[::delay] += (g * room) ** np.arange(len(y[::delay])) / len(COMB_MS)
    for ms, base in zip(ALLPASS_MS, ALLPASS_GAIN, strict=True):
        delay, g = max(1, round(ms / 1000 * rate)), base * room
        out = -g * y
        for start in range(delay, n, delay):
            stop = min(n, start + delay)
            out[start:stop] += y[start - delay : stop - delay] + g * out[start - delay : stop - delay]
        y = out
    y.flags.writeable = False
    return y


def convolved(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    size = 1 << (len(x) + len(h) - 2).bit_length() if len(x) else 1
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(h, size), size)[: len(x)] if len(x) else x


def reverb(x, rate, onset, offset, direction, mode, amount, room: float = 0.75) -> np.ndarray:
    """Dry and reverberated sound, the latter at the same RMS, mixed by a share that goes from or to 0."""
    wet = match_rms(x, convolved(x, impulse_response(int(rate), round(room, 6))))
    mix = ramp(len(x), span(len(x), rate, onset, offset), *_rising(direction, 0.0, amount), mode)
    return x * (1 - mix) + wet * mix


def lowpass_mask(freqs: np.ndarray, cutoff, width: float) -> np.ndarray:
    """1 below, 0 above, half a cosine over `width` around the cutoff, or around those of a column of cutoffs."""
    if width <= 0:
        return (freqs <= cutoff).astype(float)
    low = np.maximum(0.0, cutoff - width / 2)
    return 0.5 * (1 + np.cos(np.pi * np.clip((freqs - low) / (cutoff + width / 2 - low), 0, 1)))


def overlapped(frames: np.ndarray, h: int) -> np.ndarray:
    """The sum of frames that begin h samples apart, a hop of all frames at a time; each sample's parts in the order of the frames."""
    *lead, m, n = frames.shape
    hops = -(-n // h)
    out = np.zeros((*lead, m - 1 + hops, h))
    for j in reversed(range(hops)):
        part = frames[..., j * h : (j + 1) * h]
        out[..., j : j + m, : part.shape[-1]] += part
    return out.reshape(*lead, -1)


@lru_cache(maxsize=256)
def hann(n: int, h: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The window, and the weight of the squares of m of them that overlap."""
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    return w, np.maximum(overlapped(np.broadcast_to(w * w, (m, n)), h), 1e-12)


def masked(x: np.ndarray, mask_of, size: int = 512, hop: int = 128) -> np.ndarray:
    """Weighted overlap-add of Hann-windowed spectra times a mask; a mask of ones gives the input. x: samples, or rows of them."""
    k = x.shape[-1]
    if not k:
        return x
    n = min(size, 1 << max(2, k.bit_length() - 1))
    h = max(1, hop * n // size)
    padded = np.zeros((*x.shape[:-1], k + n // 2 + n))
    padded[..., n // 2 : n // 2 + k] = x
    frames = np.lib.stride_tricks.sliding_window_view(padded, n, axis=-1)[..., ::h, :]
    w, weight = hann(n, h, frames.shape[-2])
    out = overlapped(np.fft.irfft(np.fft.rfft(frames * w, axis=-1) * mask_of(n), n, axis=-1) * w, h)
    return (out / weight)[..., n // 2 : n // 2 + k]


def lowpassed(x: np.ndarray, rate: float, cutoffs: np.ndarray, width: float = 800.0) -> np.ndarray:
    """Rows of samples, each with the cutoff of its row and the RMS that it had."""
    y = masked(x, lambda n: lowpass_mask(np.fft.rfftfreq(n, 1 / rate), cutoffs[:, None, None], width))
    a, b = (np.sqrt(np.mean(np.square(v), axis=-1, keepdims=True)) if x.shape[-1] else np.zeros((len(x), 1)) for v in (x, y))
    return y * np.divide(a, b, out=np.ones_like(a), where=(a > 0) & (b > 0))


def lowpass(x, rate, onset, offset, direction, mode, amount) -> np.ndarray:
    """The cutoff goes between `amount` and half the rate: upward it rises."""
    return lowpass_all([(x, rate, onset, offset, direction, mode, amount)])[0]


def lowpass_all(clips: list[tuple]) -> list[np.ndarray]:
    """`lowpass` of many clips. Those of one length, rate and span are rows of one array, some ROW_SAMPLES of them at a time."""
    alike, out = {}, [None] * len(clips)
    for at, (x, rate, onset, offset, *_) in enumerate(clips):
        alike.setdefault((len(x), rate, onset, offset), []).append(at)
    for (n, rate, onset, offset), places in alike.items():
        step = max(1, ROW_SAMPLES // max(n, 1))
        for some in (places[i : i + step] for i in range(0, len(places), step)):
            ends = [(*_rising(direction, amount, rate / 2), mode) for direction, mode, amount in (clips[at][4:] for at in some)]
            y = by_steps(np.stack([clips[at][0] for at in some]), rate, onset, offset, *zip(*ends, strict=True), lambda s, v: lowpassed(s, rate, np.asarray(v, float)))
            for at, row in zip(some, y, strict=True):
                out[at] = row
    return out


def sine(hz: float, rate: int, head: float, active: float, tail: float, level: float = 0.65) -> np.ndarray:
    """A tone between silent ends."""
    n = round(active * rate)
    return np.concatenate([np.zeros(round(head * rate)), level * np.sin(2 * np.pi * hz * np.arange(n) / rate), np.zeros(round(tail * rate))])


def segment_means(frames: np.ndarray, k: int = 16) -> np.ndarray:
    """Means of k equal segments; an empty one takes the frame where it would begin, without frames all is 0."""
    frames = np.asarray(frames, float)
    n = len(frames)
    if not n:
        return np.zeros((k, frames.shape[1] if frames.ndim == 2 else 1))
    cuts = np.arange(k + 1) * n // k
    return np.stack([frames[a:b].mean(axis=0) if b > a else frames[min(a, n - 1)] for a, b in zip(cuts, cuts[1:], strict=False)])


def to_pcm(x: np.ndarray, width: int) -> bytes:
    """Samples of -1 to 1 as 8-bit unsigned or 16-bit signed PCM, clipped, fractions cut."""
    x = np.asarray(x, float)
    if width == 1:
        return np.clip(x * 128 + 128, 0, 255).astype(np.uint8).tobytes()
    if width == 2:
        return np.clip(x * 32768, -32768, 32767).astype("<i2").tobytes()
    raise ValueError(f"unsupported sample width: {width}")


def from_pcm(data: bytes, width: int, channels: int = 1) -> np.ndarray:
    """PCM as samples of -1 to 1, channels averaged."""
    if width == 1:
        x = (np.frombuffer(data, np.uint8).astype(float) - 128) / 128
    elif width == 2:
        x = np.frombuffer(data, "<i2").astype(float) / 32768
    else:
        raise ValueError(f"unsupported sample width: {width}")
    return x.reshape(-1, channels).mean(axis=1) if channels > 1 else x


EFFECTS = {"gain": gain, "noise": noise, "sample_hold": sample_hold, "quantize": quantize, "tremolo": tremolo, "reverb": reverb, "lowpass": lowpass}
#: Effects of many clips at once.
EFFECTS_OF_ALL = {"lowpass": lowpass_all}
