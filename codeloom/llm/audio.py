"""Media columns: audio stored losslessly, and features read back from what is stored.

``encode_audio`` stores bytes as 8-bit mono PCM in a WAV container. ``audio_features``
parses stored containers and computes, for each row:

* the samples at a lower rate, by a polyphase filter (rational factor up/down);
* log energies of overlapped frames in mel bands, cut into patches of fixed shape, with
  the time span of each patch;
* segments with sound, by two energy levels with hysteresis.

The patches are the column ``log_mel``: all values of a row one after the other, as Arrow
stores fixed-shape tensors, and with Arrow's extension name and shape in the column's
metadata (Spark itself has no lists of fixed size). ``tensors`` makes the Arrow tensor
array of such a column without copying values.

Samples are resampled and framed a block at a time, so a long text takes little more
memory than its bytes and its features.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import as_bytes, once, release_heavy, small_batches

HEADER = "<4sI4s4sIHHIIHH4sI"  # of a container with one format and one data chunk
HEADER_BYTES = 44


@dataclass(frozen=True)
class AudioConfig:
    """All that the features depend on."""

    rate: int = 8000
    up: int = 3
    down: int = 4
    taps_per_phase: int = 12
    frame: int = 240
    hop: int = 120
    fft: int = 256
    mels: int = 24
    patch: int = 32  # frames of a tensor patch
    silence: float = -6.0  # fills the last patch: the log energy of nothing
    block: int = 2048  # frames that are worked on at once
    on_above: float = 1.25  # times the median frame energy
    off_below: float = 0.90

    @property
    def out_rate(self) -> int:
        return self.rate * self.up // self.down


def padded(data: bytes, multiple: int = 192) -> bytes:
    """data with blanks (32) up to a positive multiple."""
    return data + b" " * (multiple - len(data) if not data else -len(data) % multiple)


def wav(samples: bytes, rate: int) -> bytes:
    """8-bit mono PCM. A chunk of odd length would need a pad byte; multiples of 192 are even."""
    pad = b"\0" * (len(samples) % 2)
    head = struct.pack(
        HEADER,
        b"RIFF", 36 + len(samples) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)
    )
    return head + samples + pad


def samples_of(stored: bytes) -> tuple[int, bytes]:
    """Rate and samples of a stored container, by its own header."""
    riff, _, kind, _, _, _, channels, rate, _, _, bits, _, n = struct.unpack_from(HEADER, stored)
    if (riff, kind, channels, bits) != (b"RIFF", b"WAVE", 1, 8):
        raise ValueError("not 8-bit mono PCM")
    return rate, stored[HEADER_BYTES : HEADER_BYTES + n]


def phases(up: int, down: int, taps: int) -> np.ndarray:
    """The low-pass filter's taps for each phase: a windowed sinc, each phase with gain 1."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t * min(1 / up, 1 / down)) * np.hamming(n)
    table = h.reshape(taps, up).T[:, ::-1]
    return np.ascontiguousarray(table / table.sum(axis=1, keepdims=True))


def resample(samples: np.ndarray, first: int, end: int, c: AudioConfig) -> np.ndarray:
    """Values first to end of the 8-bit samples at up/down times their rate.

    Output n needs only the filter phase n*down mod up. Before and after the samples is silence.
    """
    table = once(("audio-phases", c.up, c.down, c.taps_per_phase), lambda: phases(c.up, c.down, c.taps_per_phase))
    half = c.taps_per_phase // 2
    low, high = first * c.down // c.up - half, (end - 1) * c.down // c.up - half + c.taps_per_phase
    x = np.zeros(high - low)
    a, b = max(0, low), min(len(samples), high)
    x[a - low : b - low] = (samples[a:b].astype(np.float64) - 128) / 128
    windows = np.lib.stride_tricks.sliding_window_view(x, c.taps_per_phase)
    y = np.empty(end - first)
    for n in range(first, min(first + c.up, end)):  # outputs n, n + up, ... share a phase and step by down inputs
        count = len(range(n, end, c.up))
        at = n * c.down // c.up - half - low
        y[n - first :: c.up] = windows[at :: c.down][:count] @ table[n * c.down % c.up]
    return y


def mel_bank(rate: int, fft: int, mels: int) -> np.ndarray:
    """Triangles with equal steps on the mel scale, one column a band."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    f = np.arange(fft // 2 + 1) * rate / fft
    rise = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall))


def log_mel(samples: np.ndarray, c: AudioConfig) -> tuple[np.ndarray, np.ndarray]:
    """Log energies (frames x mels) and the energy of each frame of 8-bit samples; at least one frame."""
    n_out = len(samples) * c.up // c.down
    n_frames = 1 + max(0, n_out - c.frame) // c.hop
    bank = once(("audio-mel", c.out_rate, c.fft, c.mels), lambda: mel_bank(c.out_rate, c.fft, c.mels))
    window = np.hanning(c.frame)
    out, energy = np.empty((n_frames, c.mels), np.float32), np.empty(n_frames)
    for at in range(0, n_frames, c.block):
        upto = min(at + c.block, n_frames)
        first = at * c.hop
        y = resample(samples, first, min(n_out, (upto - 1) * c.hop + c.frame), c)
        y = np.pad(y, (0, max(0, c.frame - len(y))))
        frames = np.lib.stride_tricks.sliding_window_view(y, c.frame)[:: c.hop]
        power = np.abs(np.fft.rfft(frames * window, c.fft)) ** 2
        out[at:upto] = np.log10(power @ bank + 1e-6)
        energy[at:upto] = (frames * frames).mean(axis=1)
    return out, energy


def segments(energy: np.ndarray, c: AudioConfig) -> list[tuple[float, float]]:
    """Spans in seconds: from a frame above the upper level until one below the lower level."""
    mid = float(np.median(energy))
    mark = np.where(energy > mid * c.on_above, 1, np.where(energy < mid * c.off_below, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))  # the latest frame that decides
    on = np.where(last >= 0, mark[last] == 1, False)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], on.view(np.int8), [0]))))
    step = c.hop / c.out_rate
    return [(a * step, (b - 1) * step + c.frame / c.out_rate) for a, b in edge.reshape(-1, 2)]


def patches(mel: np.ndarray, c: AudioConfig) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """The values of all patches (patch x mels each, the last one filled up), and the span of each in seconds."""
    n = -(-len(mel) // c.patch)
    full = np.full((n * c.patch, c.mels), c.silence, np.float32)
    full[: len(mel)] = mel
    start = np.arange(n) * c.patch * c.hop / c.out_rate
    end = (np.minimum((np.arange(n) + 1) * c.patch, len(mel)) - 1) * c.hop / c.out_rate + c.frame / c.out_rate
    return full.ravel(), list(zip(start.tolist(), end.tolist()))


def tensors(column: pa.ListArray | pa.ChunkedArray, c: AudioConfig = AudioConfig()) -> pa.ExtensionArray:
    """The patches of a ``log_mel`` column, all rows one after the other, as an Array of fixed-shape tensors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.fixed_shape_tensor(pa.float32(), (c.patch, c.mels))
    return pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(column.flatten(), c.patch * c.mels))


def tensor_metadata(c: AudioConfig) -> dict[str, str]:
    """Arrow's own names for the extension, as metadata of a column."""
    return {"ARROW:extension:name": "arrow.fixed_shape_tensor", "ARROW:extension:metadata": json.dumps({"shape": [c.patch, c.mels]})}


def encode_audio(docs: DataFrame, key: str = "doc_id", text: str = "text", config: AudioConfig = AudioConfig()) -> DataFrame:
    """(key, n_bytes, media): every text as UTF-8, filled up to a multiple of 192, in a container.

    Null is the empty text, and 192 blanks. Equal texts give equal media.
    """
    small_batches(docs.sparkSession)
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_heavy()
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                data = [as_bytes(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(list(map(len, data)), pa.int64()),
                        pa.array([wav(padded(d), config.rate) for d in data], pa.binary()),
                    ],
                    [key, "n_bytes", "media"],
                )

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {key_type}, n_bytes bigint, media binary")


SPANS = "array<struct<start_s:double,end_s:double>>"
FEATURES = {
    "payload_bytes": "bigint",
    "payload_sha256": "string",
    "tail_crc32": "bigint",
    "media_bytes": "bigint",
    "media_sha256": "string",
    "feature": "string",
    "n_frames": "bigint",
    "segments": SPANS,
    "log_mel": "array<float>",
    "patch_spans": SPANS,
}


def features_of(stored: bytes, c: AudioConfig) -> dict:
    rate, payload = samples_of(stored)
    if rate != c.rate:
        raise ValueError(f"{rate} samples a second where {c.rate} are expected")
    mel, energy = log_mel(np.frombuffer(payload, np.uint8), c)
    spans = segments(energy, c)
    values, patch_spans = patches(mel, c)
    quarter = [float(q.mean()) for q in np.array_split(mel.mean(axis=0, dtype=np.float64), 4)]
    sound = sum(b - a for a, b in spans)
    return {
        "payload_bytes": len(payload),
        "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-16:]),
        "media_bytes": len(stored),
        "media_sha256": hashlib.sha256(stored).hexdigest(),
        "feature": f"frames={len(mel)};segments={len(spans)};sound={sound:.2f};mel=" + ",".join(f"{q:.3f}" for q in quarter),
        "n_frames": len(mel),
        "segments": spans,
        "log_mel": values,
        "patch_spans": patch_spans,
    }


def _lists(rows: list, flat: pa.Array) -> pa.ListArray:
    """One list for each row (null for None), whose values are ``flat`` in order."""
    ends = np.concatenate(([0], np.cumsum([0 if r is None else len(r) for r in rows]))).astype(np.int32)
    none = np.array([r is None for r in rows] + [False])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=none if none.any() else None), flat)


def _column(name: str, rows: list[dict]) -> pa.Array:
    values = [r.get(name) for r in rows]
    if FEATURES[name] == SPANS:
        flat = np.array([s for v in values if v for s in v], np.float64).reshape(-1, 2)
        return _lists(values, pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["start_s", "end_s"]))
    if name == "log_mel":
        some = [v for v in values if v is not None]
        return _lists(values, pa.array(np.concatenate(some) if some else np.empty(0, np.float32)))
    return pa.array(values, pa.int64() if FEATURES[name] == "bigint" else pa.string())


def audio_features(
    media: DataFrame, keep: list[str], config: AudioConfig = AudioConfig(), outputs: tuple[str, ...] = tuple(FEATURES)
) -> DataFrame:
    """The columns ``keep`` and the ``outputs`` (see FEATURES) of each stored ``media``.

    A null ``media`` gives null outputs. Rows are worked on one by one, long ones by blocks.
    """
    small_batches(media.sparkSession)
    kept = media.select(*[F.col(k) for k in keep], F.col("media"))
    schema = ", ".join([f"`{k}` {kept.schema[k].dataType.simpleString()}" for k in keep] + [f"{o} {FEATURES[o]}" for o in outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                found = [features_of(m.as_buffer().to_pybytes(), config) if m.is_valid else {} for m in part.column(len(keep))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *[_column(o, found) for o in outputs]], [*keep, *outputs])

    found = kept.mapInArrow(run, schema)
    return found.withMetadata("log_mel", tensor_metadata(config)) if "log_mel" in outputs else found
