"""Audio features of media columns.

A payload of bytes is stored as an 8-bit PCM wave file and read back. The samples are resampled by a polyphase filter,
cut into overlapping frames, and turned into log-mel filterbanks; frame energies are segmented with hysteresis. The
filterbanks of a row are stored as fixed-shape Arrow tensors (WINDOW frames x MELS bands, float32), one for each time
span, in an Arrow stream.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foragelake.llm.common import table

RATE, TARGET_RATE = 16_000, 8_000
#: Bytes of a payload are padded with zeros to a positive multiple of this.
ALIGN = 64
FRAME, HOP, MELS, WINDOW = 256, 128, 32, 64
#: A segment begins at a frame this many decibels over the row's median energy, and ends under the lower threshold.
ON_DB, OFF_DB = 1.0, -0.5
FLOOR = 1e-6
#: Zero crossings of the resampling filter on each side.
TAPS = 16
#: Output samples of the filter, and frames, that are worked on at a time.
BLOCK = 1 << 15


def encode_wave(payload: bytes, rate: int = RATE) -> bytes:
    """A mono wave file whose 8-bit samples are the bytes of the payload."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(payload) % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * (len(payload) % 2)


def decode_wave(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of a mono 8-bit wave file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no wave file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono")
        elif kind == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


@cache
def _filters(up: int, down: int, taps: int = TAPS) -> np.ndarray:
    """Windowed-sinc low-pass filter, one row for each of the `up` phases."""
    wide = max(up, down)
    n = 2 * taps * wide + 1
    t = (np.arange(n) - n // 2) / wide
    h = np.sinc(t) * np.kaiser(n, 8.0)
    h = np.append(h, np.zeros(-n % up))
    phases = h.reshape(-1, up).T[:, ::-1]
    return np.ascontiguousarray(phases / phases.sum(1, keepdims=True), np.float32)


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """Polyphase resampling by up/down: every output sample is one dot product with the filter of its phase."""
    g = np.gcd(up, down)
    up, down = int(up // g), int(down // g)
    if up == down:
        return x
    filters = _filters(up, down)
    taps = filters.shape[1]
    n = -(-len(x) * up // down)
    # Output n stands at n * down among the up-sampled samples; the filter is centred there.
    centre = TAPS * max(up, down)
    padded = np.concatenate([np.zeros(taps - 1, np.float32), x, np.zeros(centre // up + down + taps, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, taps)
    out = np.empty(n, np.float32)
    for r in range(up):
        phase, first = (r * down + centre) % up, (r * down + centre) // up
        count = len(range(r, n, up))
        for lo in range(0, count, BLOCK):
            hi = min(count, lo + BLOCK)
            out[r + lo * up : r + (hi - 1) * up + 1 : up] = windows[first + lo * down : first + (hi - 1) * down + 1 : down] @ filters[phase]
    return out


@cache
def _mel_bank(rate: int) -> np.ndarray:
    """Triangular filters, evenly spaced in mel, as columns."""
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, 1 / rate)[:, None]
    up, down = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


@cache
def _hann() -> np.ndarray:
    return np.hanning(FRAME + 1)[:-1].astype(np.float32)


def log_mel(x: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel filterbank (frames x MELS) and energy in decibels of each frame; the last frame is padded with silence."""
    n = max(1, -(-max(0, len(x) - FRAME) // HOP) + 1)
    x = np.append(x, np.zeros((n - 1) * HOP + FRAME - len(x), np.float32)) if len(x) < (n - 1) * HOP + FRAME else x
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP][:n]
    mel, energy = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    for lo in range(0, n, 1024):
        part = frames[lo : lo + 1024]
        power = np.abs(np.fft.rfft(part * _hann(), axis=1)).astype(np.float32) ** 2
        mel[lo : lo + 1024] = np.log(power @ _mel_bank(rate) + FLOOR)
        energy[lo : lo + 1024] = 10 * np.log10((part * part).mean(1) + FLOOR)
    return mel, energy


def segments(energy: np.ndarray, on: float = ON_DB, off: float = OFF_DB) -> list[tuple[int, int]]:
    """Frame ranges that begin at `on` or more over the median and last until the energy falls under `off`."""
    level = energy - np.median(energy)
    mark = np.where(level >= on, 1, np.where(level < off, -1, 0))
    at = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), 0))
    active = np.concatenate([[0], (mark[at] == 1).astype(int), [0]])
    edge = np.diff(active)
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


_TENSOR = pa.fixed_shape_tensor(pa.float32(), [WINDOW, MELS])
TENSORS = pa.schema([("features", _TENSOR), ("start_s", pa.float64()), ("end_s", pa.float64())])


def to_tensors(mel: np.ndarray, seconds: float) -> bytes:
    """An Arrow stream of tensors with their time spans; the last tensor is padded with the floor."""
    n = -(-len(mel) // WINDOW)
    full = np.full((n * WINDOW, MELS), np.log(FLOOR), np.float32)
    full[: len(mel)] = mel
    cells = pa.array(full.reshape(-1), pa.float32())
    tensors = pa.ExtensionArray.from_storage(_TENSOR, pa.FixedSizeListArray.from_arrays(cells, WINDOW * MELS))
    start = np.arange(n) * WINDOW * HOP / TARGET_RATE
    end = np.minimum(start + WINDOW * HOP / TARGET_RATE, max(seconds, 0.0))
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, TENSORS) as out:
        out.write_batch(pa.record_batch([tensors, pa.array(start), pa.array(np.maximum(start, end))], schema=TENSORS))
    return sink.getvalue()


def from_tensors(stream: bytes) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """Tensors (number x WINDOW x MELS) and time spans of an Arrow stream."""
    with pa.ipc.open_stream(stream) as found:
        t = found.read_all()
    tensors = t["features"].combine_chunks().to_numpy_ndarray()
    return tensors, list(zip(t["start_s"].to_pylist(), t["end_s"].to_pylist(), strict=True))


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def payload_of(text: str | None) -> bytes:
    raw = _raw(text)
    return raw + b"\0" * (ALIGN - len(raw) % ALIGN if len(raw) % ALIGN or not raw else 0)


def _analyse(media: bytes) -> tuple[bytes, bytes, list[dict[str, float]], str]:
    """Payload, tensors, segments (in seconds) and summary of a stored wave file."""
    payload, rate = decode_wave(media)
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    mel, energy = log_mel(resample(x, TARGET_RATE, rate), TARGET_RATE)
    stream = to_tensors(mel, len(x) / rate)
    tensors, spans = from_tensors(stream)
    step = HOP / TARGET_RATE
    found = [{"start_s": a * step, "end_s": b * step} for a, b in segments(energy)]
    active = sum(s["end_s"] - s["start_s"] for s in found) / (len(energy) * step)
    loud = float(np.round(tensors.reshape(-1, MELS)[: len(mel)].mean(), 3))
    return payload, stream, found, f"frames={len(mel)};tensors={len(spans)};end={spans[-1][1]:.4f};segments={len(found)};active={active:.4f};mel={loud:.3f}"


def audio_features(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (wave file), payload (read back from it), tensors (Arrow stream), segments, summary.

    segments are the (start_s, end_s) in which the energy is high, with hysteresis; a segment lasts through its last frame.

    Null counts as the empty text, whose payload is 64 zero bytes. Every row is worked on whole and by itself, in blocks
    of samples, so equal texts have equal results, and repeated rows are repeated. An empty table gives an empty
    result; other columns are ignored, whatever their names.
    """

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 200):
                part = batch.iloc[lo : lo + 200]
                media = [encode_wave(payload_of(t)) for t in part["text"]]
                told = [_analyse(m) for m in media]
                yield pd.DataFrame({
                    "doc_id": part["doc_id"],
                    "n_bytes": [len(_raw(t)) for t in part["text"]],
                    "media": media,
                    "payload": [x[0] for x in told],
                    "tensors": [x[1] for x in told],
                    "segments": [x[2] for x in told],
                    "summary": [x[3] for x in told],
                })

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInPandas(extract, f"doc_id {kind}, n_bytes long, media binary, payload binary, tensors binary, segments array<struct<start_s:double,end_s:double>>, summary string")


def op3_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audio_features(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -ALIGN, ALIGN)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat("summary", F.lit(";segments_crc32="), F.crc32(F.to_json("segments").cast("binary")).cast("string"), F.lit(";tensors_sha256="), F.sha2("tensors", 256)).alias("feature"),
    )
