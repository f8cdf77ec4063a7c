"""Signal kernels in numpy, free of Spark.

Defaults follow the published formulas of the usual audio toolkit: centred frames, periodic Hann window, Slaney mel
scale with area normalisation, orthonormal DCT-II, decibels against the maximum with a floor of 80 dB.
"""

from __future__ import annotations

import io
import wave
from functools import lru_cache

import numpy as np

RATE = 16_000
EPS = 1e-10


class UnsupportedAudio(ValueError):
    """An extension or a codec that can't be decoded here."""


def decode_wav(content: bytes, rate: int = RATE) -> np.ndarray:
    """Mono float32 samples in [-1, 1] at the rate: channels averaged, other rates resampled linearly in a band limited
    spectrum. 8, 16, 24 and 32 bit PCM."""
    try:
        with wave.open(io.BytesIO(content)) as w:
            channels, width, own, frames = w.getnchannels(), w.getsampwidth(), w.getframerate(), w.readframes(w.getnframes())
    except (wave.Error, EOFError) as e:
        raise UnsupportedAudio(f"no PCM WAV: {e}") from e
    frames = frames[: len(frames) // (width * channels) * width * channels]
    if width == 1:
        x = (np.frombuffer(frames, dtype=np.uint8).astype(np.float64) - 128) / 128
    elif width == 2:
        x = np.frombuffer(frames, dtype="<i2") / 32768.0
    elif width == 3:
        raw = np.frombuffer(frames, dtype=np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16) - ((raw[:, 2] >= 128).astype(np.int32) << 24)) / 8388608.0
    else:
        x = np.frombuffer(frames, dtype="<i4") / 2147483648.0
    if channels > 1:
        x = x.reshape(-1, channels).mean(axis=1)
    return resample(x, own, rate).astype(np.float32)


def encode_wav(samples, rate: int = RATE) -> bytes:
    """16-bit PCM; samples beyond [-1, 1] are cut."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(np.rint(np.asarray(samples, dtype=np.float64) * 32768), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def pcm16(x: np.ndarray) -> np.ndarray:
    """What a round trip through 16-bit PCM leaves of samples."""
    return (np.clip(np.rint(np.asarray(x, dtype=np.float64) * 32768), -32768, 32767) / 32768).astype(np.float32)


def resample(x: np.ndarray, own: int, rate: int) -> np.ndarray:
    """In the Fourier domain; the length becomes ceil(n * rate / own)."""
    if own == rate or not len(x):
        return x
    n = -(-len(x) * rate // own)
    spectrum = np.fft.rfft(x)
    kept = np.zeros(n // 2 + 1, dtype=complex)
    m = min(len(spectrum), len(kept))
    kept[:m] = spectrum[:m]
    return np.fft.irfft(kept, n) * (n / len(x))


def preprocess(x: np.ndarray, coefficient: float = 0.97) -> np.ndarray:
    """Without mean, pre-emphasised, peak-normalised."""
    x = np.asarray(x, dtype=np.float32)
    if not len(x):
        return x
    x = x - x.mean()
    x = np.concatenate([x[:1], x[1:] - np.float32(coefficient) * x[:-1]])
    return x / (np.abs(x).max() + 1e-8)


def _framed(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    n = 1 + (len(x) - size) // hop
    return np.lib.stride_tricks.sliding_window_view(x, size)[: (n - 1) * hop + 1 : hop]


def power_spectrum(x: np.ndarray, n_fft: int = 512, hop: int = 160) -> np.ndarray:
    """(frames, bins) of centred frames padded with zeros, periodic Hann window."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    padded = np.pad(np.asarray(x, dtype=np.float64), n_fft // 2)
    return np.abs(np.fft.rfft(_framed(padded, n_fft, hop) * window, axis=1)) ** 2


def hz_to_mel(f):
    """Slaney: linear to 1 kHz, then logarithmic."""
    f = np.asarray(f, dtype=np.float64)
    return np.where(f < 1000, f * 3 / 200, 15 + np.log(np.maximum(f, 1e-9) / 1000) * 27 / np.log(6.4))


def mel_to_hz(m):
    m = np.asarray(m, dtype=np.float64)
    return np.where(m < 15, m * 200 / 3, 1000 * np.exp((m - 15) * np.log(6.4) / 27))


@lru_cache(maxsize=16)
def mel_filters(bands: int = 40, n_fft: int = 512, rate: int = RATE, fmin: float = 0.0, fmax: float | None = None) -> np.ndarray:
    """(bands, bins) triangles of unit area."""
    edges = mel_to_hz(np.linspace(hz_to_mel(fmin), hz_to_mel(fmax or rate / 2), bands + 2))
    bins = np.arange(n_fft // 2 + 1) * rate / n_fft
    left, mid, right = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((bins - left) / (mid - left), (right - bins) / (right - mid))) * 2 / (right - left)


def decibels(power: np.ndarray, floor: float = 1e-10, range_db: float = 80.0) -> np.ndarray:
    db = 10 * np.log10(np.maximum(power, floor)) - 10 * np.log10(max(power.max(initial=0), floor))
    return np.maximum(db, db.max(initial=-np.inf) - range_db)


@lru_cache(maxsize=8)
def dct_matrix(n_out: int, n_in: int) -> np.ndarray:
    k, i = np.arange(n_out)[:, None], np.arange(n_in)[None, :]
    out = np.sqrt(2 / n_in) * np.cos(np.pi * k * (2 * i + 1) / (2 * n_in))
    out[0] = np.sqrt(1 / n_in)
    return out


def mfcc(x: np.ndarray, n: int = 20, fmin: float = 0.0, fmax: float | None = None) -> np.ndarray:
    """(n, frames)."""
    mel = power_spectrum(x) @ mel_filters(fmin=fmin, fmax=fmax).T
    return dct_matrix(n, mel.shape[1]) @ decibels(mel).T


def coefficient_stats(rows: np.ndarray) -> np.ndarray:
    """Mean, population deviation, biased skewness, 10th and 90th percentile of each row; no spread, no skew."""
    mean, std = rows.mean(axis=1), rows.std(axis=1)
    third = ((rows - mean[:, None]) ** 3).mean(axis=1)
    skew = np.where(std > 1e-12, third / np.maximum(std, 1e-12) ** 3, 0.0)
    return np.stack([mean, std, skew, *np.percentile(rows, [10, 90], axis=1)], axis=1)


def features_104(x: np.ndarray, fmin: float = 0.0, fmax: float | None = None) -> np.ndarray:
    """Five statistics of each of 20 MFCCs, then mean zero-crossing rate, centroid, flatness and RMS."""
    x = np.asarray(x, dtype=np.float64)
    big, hop = 2048, 512
    edge = np.pad(x, big // 2, mode="edge") if len(x) else np.zeros(big)
    signs = np.signbit(_framed(edge, big, hop))
    crossings = (signs[:, 1:] != signs[:, :-1]).sum(axis=1) / big
    zero = np.pad(x, big // 2)
    spectrum = np.sqrt(power_spectrum(x, big, hop))
    total = spectrum.sum(axis=1)
    centroid = np.where(total > 0, (spectrum * (np.arange(big // 2 + 1) * RATE / big)).sum(axis=1) / np.maximum(total, 1e-300), 0.0)
    power = np.maximum(spectrum**2, EPS)
    flatness = np.exp(np.log(power).mean(axis=1)) / power.mean(axis=1)
    rms = np.sqrt((_framed(zero, big, hop) ** 2).mean(axis=1))
    return np.concatenate([coefficient_stats(mfcc(x, 20, fmin, fmax)).ravel(), [crossings.mean(), centroid.mean(), flatness.mean(), rms.mean()]])


#: Names of the nine environment features, in order.
ENVIRONMENT = (
    "noise_floor_rms", "speech_rms", "snr_estimate_db", "spectral_flatness_mean", "spectral_centroid_mean", "zcr_mean", "zcr_std",
    "energy_dynamic_range", "band_energy_ratio_mean",
)


def environment_features(x: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Nine features of 25 ms frames every 10 ms; frames above the 60th percentile of energy count as voice."""
    size, hop = rate * 25 // 1000, rate * 10 // 1000
    x = np.asarray(x, dtype=np.float64)
    frames = _framed(np.pad(x, (0, max(0, size - len(x)))), size, hop)
    energy = np.sqrt((frames**2).mean(axis=1) + EPS)
    crossings = np.abs(np.diff(np.where(frames >= 0, 1, -1), axis=1)).mean(axis=1) / 2
    magnitude = np.abs(np.fft.rfft(frames * np.hanning(size), axis=1))
    spectrum = magnitude + EPS
    freq = np.fft.rfftfreq(size, 1 / rate)
    flatness = np.exp(np.log(spectrum).mean(axis=1)) / spectrum.mean(axis=1)
    centroid = (spectrum * freq).sum(axis=1) / spectrum.sum(axis=1)
    power = magnitude**2 + EPS
    band = power[:, (freq >= 300) & (freq <= 1000)].sum(axis=1) / power.sum(axis=1)
    voice = energy > np.percentile(energy, 60)
    rest = ~voice
    noise = energy[rest].mean() if rest.any() else energy.mean()
    speech = energy[voice].mean() if voice.any() else energy.mean()
    quiet = rest if rest.any() else np.ones(len(energy), dtype=bool)
    return np.array([
        noise, speech, 20 * np.log10((speech + EPS) / (noise + EPS)), flatness[quiet].mean(), centroid.mean(), crossings.mean(), crossings.std(),
        np.percentile(energy, 95) - np.percentile(energy, 5), band[quiet].mean(),
    ])


def crossfade(before: np.ndarray, after: np.ndarray, rate: int = RATE) -> tuple[np.ndarray, np.ndarray]:
    """Both sides of a seam faded over 20 ms: the tail by falling, the head by rising gains of one ramp over the window,
    cut to the shorter side."""
    half = rate // 100
    n = min(half, len(before)) + min(half, len(after))
    if n <= 1:
        return before, after
    mid = min(half, len(before), len(after))
    ramp = np.linspace(0, 1, n)[:mid]
    before, after = before.astype(np.float64).copy(), after.astype(np.float64).copy()
    if mid:
        before[-mid:] *= 1 - ramp
        after[:mid] *= ramp
    return before, after


def kmeans(x: np.ndarray, k: int, runs: int = 10, seed: int = 42, steps: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """Centres, labels and inertia of the best of several runs, started by distance-weighted draws."""
    rng, best = np.random.default_rng(seed), None
    for _ in range(runs):
        centres = x[[rng.integers(len(x))]]
        while len(centres) < k:
            d = ((x[:, None] - centres) ** 2).sum(-1).min(axis=1)
            centres = np.concatenate([centres, x[[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))]]])
        for _ in range(steps):
            own = ((x[:, None] - centres) ** 2).sum(-1).argmin(axis=1)
            new = np.stack([x[own == j].mean(axis=0) if (own == j).any() else centres[j] for j in range(k)])
            if np.allclose(new, centres, rtol=0, atol=1e-12):
                break
            centres = new
        d = ((x[:, None] - centres) ** 2).sum(-1)
        if best is None or d.min(axis=1).sum() < best[2] - 1e-12:
            best = centres, d.argmin(axis=1), float(d.min(axis=1).sum())
    return best
