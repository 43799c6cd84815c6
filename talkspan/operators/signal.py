"""Signal features: framing, spectra, mel banks, cepstra, and short-time transforms.

The numeric kernels are numpy over all frames of an item at once; `features` runs them in Arrow batches of items.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, astuple, dataclass, field, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

EPSILON = float(np.finfo(np.float32).eps)


class _Options:
    """Options that turn into plain dictionaries and back; unknown names raise."""

    def as_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, values: dict):
        out = cls()
        for k, v in values.items():
            if not hasattr(out, k):
                raise ValueError(f"unknown option {k!r}")
            now = getattr(out, k)
            setattr(out, k, type(now).from_dict(v) if isinstance(now, _Options) else v)
        return out


@dataclass
class FrameOptions(_Options):
    samp_freq: float = 16000.0
    frame_shift_ms: float = 10.0
    frame_length_ms: float = 25.0
    dither: float = 0.0
    preemph_coeff: float = 0.97
    remove_dc_offset: bool = True
    window_type: str = "povey"
    round_to_power_of_two: bool = True
    blackman_coeff: float = 0.42
    snip_edges: bool = True

    @property
    def length(self) -> int:
        return int(self.samp_freq * 0.001 * self.frame_length_ms)

    @property
    def shift(self) -> int:
        return int(self.samp_freq * 0.001 * self.frame_shift_ms)

    @property
    def padded(self) -> int:
        return 1 << (self.length - 1).bit_length() if self.round_to_power_of_two else self.length


@dataclass
class MelOptions(_Options):
    num_bins: int = 25
    low_freq: float = 20.0
    high_freq: float = 0.0
    htk_mode: bool = False
    is_librosa: bool = False
    norm: str = "slaney"
    use_slaney_mel_scale: bool = True
    floor_to_int_bin: bool = False


@dataclass
class FbankOptions(_Options):
    frame_opts: FrameOptions = field(default_factory=FrameOptions)
    mel_opts: MelOptions = field(default_factory=lambda: MelOptions(num_bins=23))
    use_energy: bool = False
    energy_floor: float = 0.0
    raw_energy: bool = True
    htk_compat: bool = False
    use_log_fbank: bool = True
    use_power: bool = True


@dataclass
class MfccOptions(_Options):
    frame_opts: FrameOptions = field(default_factory=FrameOptions)
    mel_opts: MelOptions = field(default_factory=lambda: MelOptions(num_bins=23))
    num_ceps: int = 13
    use_energy: bool = True
    energy_floor: float = 0.0
    raw_energy: bool = True
    cepstral_lifter: float = 22.0
    htk_compat: bool = False


def frame_count(n: int, o: FrameOptions, flush: bool = True) -> int:
    """Frames of n samples. Without snip and before the end, frames that would reach beyond n wait."""
    if o.snip_edges:
        return 0 if n < o.length else 1 + (n - o.length) // o.shift
    count = (n + o.shift // 2) // o.shift
    if flush:
        return count
    return max(0, min(count, (n - o.length - first_sample(0, o)) // o.shift + 1)) if n >= o.length + first_sample(0, o) else 0


def first_sample(frame: int, o: FrameOptions) -> int:
    return frame * o.shift if o.snip_edges else frame * o.shift + o.shift // 2 - o.length // 2


def mirrored(i: np.ndarray, n: int) -> np.ndarray:
    m = np.mod(i, 2 * n)
    return np.where(m < n, m, 2 * n - 1 - m)


def framed(x: np.ndarray, o: FrameOptions) -> np.ndarray:
    """A row a frame; samples beyond the ends are mirrored."""
    n = frame_count(len(x), o)
    if n <= 0 or not len(x):
        return np.zeros((0, o.length))
    lo, hi = first_sample(0, o), first_sample(n - 1, o) + o.length
    if lo < 0 or hi > len(x):  # only what lies beyond the ends is looked up
        before, after = mirrored(np.arange(lo, min(0, hi)), len(x)), mirrored(np.arange(max(len(x), lo), hi), len(x))
        x, lo = np.concatenate((x[before], x[max(0, lo) : hi], x[after])), 0
    return np.lib.stride_tricks.sliding_window_view(x[lo:], o.length)[:: o.shift][:n]


def window(kind: str, n: int, blackman: float = 0.42) -> np.ndarray:
    return _window(kind, n, blackman).copy()


@lru_cache(32)
def _window(kind: str, n: int, blackman: float = 0.42) -> np.ndarray:
    i = np.arange(n)
    a = 2 * np.pi * i / (n - 1)
    shapes: dict[str, Callable[[], np.ndarray]] = {
        "hanning": lambda: 0.5 - 0.5 * np.cos(a), "sine": lambda: np.sin(a / 2), "hamming": lambda: 0.54 - 0.46 * np.cos(a), "hann": lambda: 0.5 - 0.5 * np.cos(2 * np.pi * i / n),
        "povey": lambda: (0.5 - 0.5 * np.cos(a)) ** 0.85, "rectangular": lambda: np.ones(n), "blackman": lambda: blackman - 0.5 * np.cos(a) + (0.5 - blackman) * np.cos(2 * a),
    }
    if kind not in shapes:
        raise ValueError(f"unknown window {kind!r}")
    return shapes[kind]()


def log_energy(frames: np.ndarray) -> np.ndarray:
    return np.log(np.maximum((frames * frames).sum(1), EPSILON))


def processed(frames: np.ndarray, o: FrameOptions, raw_energy: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Frames without offset, pre-emphasised, windowed and padded; and their log energy, of the frames before
    pre-emphasis if raw."""
    out = np.zeros((len(frames), o.padded))
    f = np.subtract(frames, frames.mean(1, keepdims=True)) if o.remove_dc_offset and len(frames) else frames
    energy = log_energy(f) if raw_energy else None
    part = out[:, : o.length]
    if o.preemph_coeff:
        np.multiply(f[:, :1], -o.preemph_coeff, out=part[:, :1])
        np.multiply(f[:, :-1], -o.preemph_coeff, out=part[:, 1:])
        part += f
    else:
        part[:] = f
    part *= _window(o.window_type, o.length, o.blackman_coeff)
    return out, log_energy(part) if energy is None else energy


def packed_rfft(x: np.ndarray) -> np.ndarray:
    """[re0, re(n/2), re1, im1, ...] of an even number of samples."""
    n = x.shape[-1]
    if n % 2:
        raise ValueError("an even number of samples is needed")
    s = np.fft.rfft(x)
    out = np.empty(x.shape)
    out[..., 0], out[..., 1] = s[..., 0].real, s[..., -1].real
    out[..., 2::2], out[..., 3::2] = s[..., 1:-1].real, s[..., 1:-1].imag
    return out


def unpacked_irfft(p: np.ndarray) -> np.ndarray:
    """The inverse of packed_rfft(), times the number of samples."""
    n = p.shape[-1]
    s = np.zeros((*p.shape[:-1], n // 2 + 1), complex)
    s[..., 0], s[..., -1] = p[..., 0], p[..., 1]
    s[..., 1:-1] = p[..., 2::2] + 1j * p[..., 3::2]
    return np.fft.irfft(s, n) * n


def mel(hz):
    return 1127.0 * np.log1p(np.asarray(hz, float) / 700.0)


def mel_slaney(hz):
    hz = np.asarray(hz, float)
    return np.where(hz < 1000, hz * 3 / 200, 15 + 27 * np.log(np.maximum(hz, 1e-9) / 1000) / np.log(6.4))


def hz_slaney(m):
    m = np.asarray(m, float)
    return np.where(m < 15, m * 200 / 3, 1000 * np.exp((m - 15) * np.log(6.4) / 27))


def mel_bank(o: MelOptions, rate: float, padded: int, warp: Callable | None = None) -> np.ndarray:
    """Triangles on the mel scale, a row a bin over padded / 2 spectrum bins. warp changes the triangles' corners."""
    top = o.high_freq if o.high_freq > 0 else rate / 2 + o.high_freq
    if not (o.num_bins >= 3 and 0 <= o.low_freq < top <= rate / 2):
        raise ValueError("the bank's limits do not fit")
    corners = np.linspace(mel(o.low_freq), mel(top), o.num_bins + 2)
    if warp is not None:
        corners = mel(warp(700 * np.expm1(corners / 1127)))
    at = mel(rate / padded * np.arange(padded // 2))[None, :]
    left, centre, right = corners[:-2, None], corners[1:-1, None], corners[2:, None]
    w = np.where(at <= centre, (at - left) / (centre - left), (right - at) / (right - centre))
    w = np.where((at > left) & (at < right), w, 0)
    if o.htk_mode and o.low_freq != 0:
        w[0, 0] = 0
    return w


def slaney_bank(o: MelOptions, rate: float, padded: int) -> np.ndarray:
    """Triangles over frequency between corners on the Slaney scale (or the other one), by area if norm is "slaney";
    all padded / 2 + 1 bins of the spectrum. floor_to_int_bin moves corners down to whole bins and counts in bins."""
    top = o.high_freq if o.high_freq > 0 else rate / 2 + o.high_freq
    if o.use_slaney_mel_scale:
        corners = hz_slaney(np.linspace(mel_slaney(o.low_freq), mel_slaney(top), o.num_bins + 2))
    else:
        corners = 700 * np.expm1(np.linspace(mel(o.low_freq), mel(top), o.num_bins + 2) / 1127)
    at = np.arange(padded // 2 + 1) * rate / padded
    if o.floor_to_int_bin:
        corners, at = np.trunc(corners * (padded + 1) / rate), np.arange(padded // 2 + 1.0)
    left, centre, right = corners[:-2, None], corners[1:-1, None], corners[2:, None]
    with np.errstate(divide="ignore", invalid="ignore"):  # corners of one bin: no bin lies between them
        w = np.where(at <= centre, (at - left) / (centre - left), (right - at) / (right - centre))
        w = np.where((at > left) & (at < right), w, 0)
        return np.where(w > 0, w * (2 / (right - left)), 0) if o.norm == "slaney" else w


def _mels(frames: np.ndarray, fo: FrameOptions, mo: MelOptions, power: bool, raw: bool) -> tuple[np.ndarray, np.ndarray]:
    f, energy = processed(frames, fo, raw)
    s = np.fft.rfft(f)
    s = _power(s) if power else np.abs(s)
    bank = _bank(astuple(mo), fo.samp_freq, fo.padded)
    return s[:, : bank.shape[1]] @ bank.T, energy


def _power(s: np.ndarray) -> np.ndarray:
    return s.real * s.real + s.imag * s.imag


@lru_cache(32)
def _bank(options: tuple, rate: float, padded: int) -> np.ndarray:
    """The bank of the MelOptions that have these values: the same for every item."""
    o = MelOptions(*options)
    return slaney_bank(o, rate, padded) if o.is_librosa else mel_bank(o, rate, padded)


def fbank(x: np.ndarray, o: FbankOptions) -> np.ndarray:
    m, energy = _mels(framed(x, o.frame_opts), o.frame_opts, o.mel_opts, o.use_power, o.raw_energy)
    if o.use_log_fbank:
        m = np.log(np.maximum(m, EPSILON))
    if not o.use_energy:
        return m
    if o.energy_floor > 0:
        energy = np.maximum(energy, np.log(o.energy_floor))
    return np.concatenate((m, energy[:, None]) if o.htk_compat else (energy[:, None], m), axis=1)


def mfcc(x: np.ndarray, o: MfccOptions) -> np.ndarray:
    n = o.mel_opts.num_bins
    if o.num_ceps > n:
        raise ValueError("there cannot be more cepstra than bins")
    m, energy = _mels(framed(x, o.frame_opts), o.frame_opts, o.mel_opts, True, o.raw_energy)
    k, j = np.arange(o.num_ceps)[:, None], np.arange(n)[None, :]
    basis = np.where(k == 0, np.sqrt(1 / n), np.sqrt(2 / n) * np.cos(np.pi / n * (j + 0.5) * k))
    c = np.log(np.maximum(m, EPSILON)) @ basis.T
    if o.cepstral_lifter:
        c = c * (1 + 0.5 * o.cepstral_lifter * np.sin(np.pi * np.arange(o.num_ceps) / o.cepstral_lifter))
    if o.use_energy:
        c[:, 0] = np.maximum(energy, np.log(o.energy_floor)) if o.energy_floor > 0 else energy
    if o.htk_compat:
        first = c[:, :1] if o.use_energy else c[:, :1] * np.sqrt(2)
        c = np.concatenate((c[:, 1:], first), axis=1)
    return c


def whisper_mel(x: np.ndarray, bins: int = 80, n_fft: int = 400, hop: int = 160, rate: float = 16000.0) -> np.ndarray:
    """Slaney mel energies of 25 ms frames, without logarithms; frames stand about their middle."""
    o = FrameOptions(samp_freq=rate, frame_shift_ms=hop / rate * 1000, frame_length_ms=n_fft / rate * 1000, snip_edges=False)
    s = _power(np.fft.rfft(framed(x, o) * _window("hann", n_fft)))
    return s @ _bank(astuple(MelOptions(num_bins=bins, low_freq=0.0, is_librosa=True)), rate, n_fft).T


def raw_frames(x: np.ndarray, length: int = 480, shift: int = 480) -> np.ndarray:
    n = 0 if len(x) < length else 1 + (len(x) - length) // shift
    return x[np.arange(n)[:, None] * shift + np.arange(length)[None, :]]


@dataclass
class StftOptions(_Options):
    n_fft: int = 400
    hop_length: int = 160
    win_length: int = 400
    window_type: str = "hann"
    center: bool = True
    pad_mode: str = "reflect"
    normalized: bool = False

    def weights(self) -> np.ndarray:
        """The window in the middle of n_fft points."""
        w = window(self.window_type, self.win_length) if self.window_type else np.ones(self.win_length)
        left = (self.n_fft - self.win_length) // 2
        return np.pad(w, (left, self.n_fft - self.win_length - left))


def stft(x: np.ndarray, o: StftOptions) -> np.ndarray:
    """Complex spectra, a row a frame."""
    if o.center:
        mode = {"constant": "constant", "reflect": "reflect", "replicate": "edge"}[o.pad_mode]
        x = np.pad(x, o.n_fft // 2, mode=mode)
    f = raw_frames(x, o.n_fft, o.hop_length) * o.weights()
    s = np.fft.rfft(f)
    return s / np.sqrt(o.n_fft) if o.normalized else s


def istft(s: np.ndarray, o: StftOptions) -> np.ndarray:
    """Overlap-add with the sum of squared windows below."""
    if o.normalized:
        s = s * np.sqrt(o.n_fft)
    w = o.weights()
    f = np.fft.irfft(s, o.n_fft) * w
    size = o.n_fft + o.hop_length * (len(f) - 1)
    out, below = np.zeros(size), np.zeros(size)
    for i, row in enumerate(f):
        at = slice(i * o.hop_length, i * o.hop_length + o.n_fft)
        out[at] += row
        below[at] += w * w
    out = np.divide(out, below, out=out.copy(), where=below > 1e-10)
    return out[o.n_fft // 2 : size - o.n_fft // 2] if o.center else out


def mean_normalised(m: np.ndarray) -> np.ndarray:
    return m - m.mean(0, keepdims=True) if len(m) else m


#: Feature presets by product: options, the samples' scale, whether bins lose their mean.
def preset(name: str) -> tuple[FbankOptions, float, bool]:
    base = FbankOptions(mel_opts=MelOptions(num_bins=80))
    if name == "recognition":
        return replace(base, frame_opts=FrameOptions(snip_edges=False), mel_opts=MelOptions(num_bins=80, high_freq=-400.0)), 1.0, False
    if name == "campp":
        return base, 32768.0, True
    if name == "wespeaker":
        return replace(base, frame_opts=FrameOptions(window_type="hamming")), 32768.0, True
    raise ValueError(f"unknown preset {name!r}")


def preset_features(x: np.ndarray, name: str) -> np.ndarray:
    o, scale, centred = preset(name)
    m = fbank(x * scale, o)
    if name == "campp":
        m = np.maximum(m, 0)
    return mean_normalised(m) if centred else m


#: Numbers in a batch of features, unless one item has more.
GATHERED = 1 << 20


def features(signals: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], key: str = "item_id", samples: str = "samples") -> DataFrame:
    """key, frame_no int, mel array<float>: kernel (samples to rows of features) over each row's samples. Null or
    empty samples give no frames."""
    return side_by_side(signals, {"": kernel}, "kernel", key, samples).drop("kernel")


def side_by_side(signals: DataFrame, kernels: dict[str, Callable[[np.ndarray], np.ndarray]], name: str, key: str = "item_id", samples: str = "samples") -> DataFrame:
    """key, frame_no int, mel array<float>, and `name` string: features() of each kernel, in one pass over the samples."""
    kind = dict(signals.dtypes)[key]

    def batch(keys: pa.Array, parts: list[tuple[int, str, np.ndarray]]) -> pa.RecordBatch:
        counts, widths = [len(m) for _, _, m in parts], [m.shape[1] for _, _, m in parts]
        ends = np.concatenate(([0], np.cumsum(np.repeat(widths, counts))))
        mel_ = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([m.ravel() for _, _, m in parts])))
        names = list(kernels)
        columns = [
            keys.take(pa.array(np.repeat([i for i, _, _ in parts], counts))), pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in counts])),
            mel_, pa.array(names).take(pa.array(np.repeat([names.index(k) for _, k, _ in parts], counts))),
        ]
        return pa.RecordBatch.from_arrays(columns, [key, "frame_no", "mel", name])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, size = [], 0
            for i in range(b.num_rows):
                x = b.column(1)[i]
                if not x.is_valid or not len(x.values):
                    continue
                x = x.values.to_numpy(zero_copy_only=False).astype(float, copy=False)
                for k, kernel in kernels.items():
                    m = kernel(x)
                    if len(m):
                        parts.append((i, k, m.astype(np.float32)))
                        size += m.size
                    if size >= GATHERED:
                        yield batch(b.column(0), parts)
                        parts, size = [], 0
            if parts:
                yield batch(b.column(0), parts)

    return signals.select(key, samples).mapInArrow(run, f"{key} {kind}, frame_no int, mel array<float>, {name} string")


def affine(rows: DataFrame, vector: str, weight: np.ndarray, bias: np.ndarray | None = None) -> DataFrame:
    """rows with vector @ weight + bias in place of vector; the matrix is a fixed parameter."""
    from pyspark.sql import functions as F

    @F.pandas_udf("array<double>")
    def run(v):
        import pandas as pd

        m = np.stack(v.to_numpy()) @ weight
        return pd.Series(list(m if bias is None else m + bias))

    return rows.withColumn(vector, run(vector))


def xvector(x: np.ndarray, mean1: np.ndarray, lda: np.ndarray, mean2: np.ndarray) -> np.ndarray:
    """Centred, to the sphere of radius sqrt(dimensions), projected, centred, to the smaller sphere."""
    unit = lambda v: v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-20)
    return np.sqrt(lda.shape[1]) * unit(np.sqrt(lda.shape[0]) * unit(x - mean1) @ lda - mean2)


def plda_basis(transform: np.ndarray, psi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Basis that makes within-class variance the identity and between-class variance diagonal, and that diagonal,
    falling: of a PLDA transform and its variances, by Cholesky and a symmetric eigenproblem."""
    within = np.linalg.inv(transform.T @ transform)
    between = np.linalg.inv((transform.T / psi) @ transform)
    low = np.linalg.inv(np.linalg.cholesky(within))
    values, vectors = np.linalg.eigh(low @ between @ low.T)
    return (low.T @ vectors)[:, ::-1].T, values[::-1]


def diagnostic_signal(n: int = 48_123, rate: float = 16_000.0) -> np.ndarray:
    t = np.arange(n) / rate
    return sum(a * np.sin(2 * np.pi * f * t) for f, a in ((233.0, 0.07), (701.0, 0.03), (1234.5, 0.01)))


def resample(x: np.ndarray, rate: int, to: int = 16_000) -> np.ndarray:
    """Linear interpolation."""
    if rate == to or not len(x):
        return x
    n = int(len(x) * to / rate)
    return np.interp(np.arange(n) * rate / to, np.arange(len(x)), x)
