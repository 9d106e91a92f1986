"""Media columns: text bytes as 8-bit audio, and audio features as fixed-shape Arrow tensors with time spans.

The payload is the text's UTF-8 bytes and zero bytes up to a positive multiple of 64. It is stored as the samples of a mono
8-bit WAV file of 16 kHz, which holds bytes as they are. All values come from the file as read back: the payload's digests
and the features. Features: polyphase resampling to 8 kHz, log-mel filterbanks over frames that overlap by half, and energy
segments with hysteresis (a segment opens above the high level and closes below the low one). The log-mel frames form tensors
of PATCH_FRAMES x MELS, the last one filled with the floor, each with its time span in seconds; they are stored as an Arrow
stream, and the feature digest is taken from the stream as read back.

Defined cases: a null text is an empty one (64 zero bytes); equal texts have equal values; a long text is framed in blocks,
so memory follows its bytes and not its frames; a null id stays; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATE, UP, DOWN, TAPS = 16_000, 1, 2, 8
FRAME, HOP, MELS, PATCH_FRAMES = 256, 128, 20, 32
FLOOR = np.float32(-10.0)
#: Levels at which a segment opens and closes, in standard deviations of the frames' dB above their median.
OPENS, CLOSES = 0.5, 0.0


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The padded bytes of a text, and how many it has unpadded."""
    raw = (text or "").encode("utf-8", "replace")
    return raw + bytes(-len(raw) % 64 if raw else 64), len(raw)


def store(payload: bytes) -> bytes:
    """A WAV file of 8-bit mono samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((1, 1, RATE, len(payload), "NONE", "not compressed"))
        w.writeframes(payload)
    return out.getvalue()


def read_back(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def _filter(up: int, down: int, taps: int) -> np.ndarray:
    """A windowed-sinc low pass, as one row of 2 * taps weights for each phase."""
    wide = max(up, down)
    t = np.arange(-taps * wide + 1, taps * wide + 1) if up > 1 else np.arange(-taps * wide, taps * wide)
    h = np.sinc(t / wide) * np.hanning(len(t)) / wide * up
    h = np.pad(h, (0, -len(h) % up))
    return np.ascontiguousarray(h.reshape(-1, up).T[:, ::-1], np.float32)


_PHASES = _filter(UP, DOWN, TAPS)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, phases: np.ndarray | None = None) -> np.ndarray:
    """Polyphase resampling by up / down: each output sample uses one phase of the filter, so no zeros are multiplied."""
    phases = (_PHASES if (up, down) == (UP, DOWN) else _filter(up, down, TAPS)) if phases is None else phases
    width, n = phases.shape[1], -(-len(x) * up // down)
    padded = np.pad(x, (width // 2, width + down))
    out = np.zeros(n, np.float32)
    for phase in range(up):
        # outputs whose place among the inputs falls on this phase
        ks = np.flatnonzero((np.arange(min(n, up)) * down) % up == phase)
        for k in ks:
            first, count = (k * down) // up, len(out[k::up])
            for j in range(width):
                out[k::up] += phases[phase, j] * padded[first + j :: down][:count]
    return out


def _mel_weights() -> np.ndarray:
    to_mel, from_mel = (lambda f: 2595 * np.log10(1 + f / 700)), (lambda m: 700 * (10 ** (m / 2595) - 1))
    top = RATE * UP / DOWN / 2
    edges = from_mel(np.linspace(to_mel(20.0), to_mel(top), MELS + 2))
    f = np.linspace(0, top, FRAME // 2 + 1)[:, None]
    rise, fall = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


_MEL, _HANN = _mel_weights(), np.hanning(FRAME).astype(np.float32)


def log_mel(x: np.ndarray) -> np.ndarray:
    """(frames, MELS) log10 energies over half-overlapping frames; the end is filled with zeros."""
    n = max(1, -(-max(0, len(x) - FRAME) // HOP) + 1)
    x = np.pad(x, (0, (n - 1) * HOP + FRAME - len(x)))
    frames, out = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP], np.empty((n, MELS), np.float32)
    for at in range(0, n, 2048):
        power = np.abs(np.fft.rfft(frames[at : at + 2048] * _HANN, axis=1)).astype(np.float32) ** 2
        out[at : at + 2048] = np.log10(np.maximum(power @ _MEL, np.float32(1e-10)))
    return out


def segments(mel: np.ndarray) -> list[tuple[float, float]]:
    """Time spans, in seconds, of frames with energy, by two levels around the median."""
    energy = 10 * np.log10((10.0 ** mel.astype(np.float64)).sum(1))
    level, spread = np.median(energy), energy.std()
    turn = np.where(energy > level + OPENS * spread, 1, np.where(energy < level + CLOSES * spread, -1, 0))
    last = np.maximum.accumulate(np.where(turn != 0, np.arange(len(turn)), -1))
    on = np.where(last >= 0, turn[last], -1) > 0
    edge = np.flatnonzero(np.diff(np.r_[False, on, False].astype(np.int8)))
    seconds = HOP * DOWN / (RATE * UP)
    return [(float(a * seconds), float(b * seconds)) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def tensors(mel: np.ndarray) -> pa.RecordBatch:
    """The frames as a fixed-shape tensor column, with the time span of each."""
    n = -(-len(mel) // PATCH_FRAMES)
    full = np.full((n * PATCH_FRAMES, MELS), FLOOR, np.float32)
    full[: len(mel)] = mel
    kind = pa.fixed_shape_tensor(pa.float32(), [PATCH_FRAMES, MELS])
    values = pa.FixedSizeListArray.from_arrays(pa.array(full.ravel()), PATCH_FRAMES * MELS)
    starts = np.arange(n) * PATCH_FRAMES * HOP * DOWN / (RATE * UP)
    ends = np.minimum(starts + PATCH_FRAMES * HOP * DOWN / (RATE * UP), len(mel) * HOP * DOWN / (RATE * UP))
    return pa.RecordBatch.from_arrays([pa.ExtensionArray.from_storage(kind, values), pa.array(starts), pa.array(ends)], ["log_mel", "start_s", "end_s"])


def _ipc(batch: pa.RecordBatch) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return out.getvalue()


def load_tensors(stored: bytes) -> pa.Table:
    """The tensor table from a features column."""
    return pa.ipc.open_stream(stored).read_all()


DIGESTS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, n_tensors long, tensors_sha256 string, n_segments long, active_s double"


def _row(text: str | None, keep: bool) -> dict:
    payload, n_bytes = payload_of(text)
    media = store(payload)
    back = read_back(media)
    mel = log_mel(resample((np.frombuffer(back, np.uint8).astype(np.float32) - 128) / 128))
    stored = _ipc(tensors(mel))
    spans = segments(mel)
    # the feature is that of the frames as stored
    kept = load_tensors(stored)
    frames = kept.column("log_mel").combine_chunks().to_numpy_ndarray().reshape(-1, MELS)[: len(mel)]
    means, spreads = frames.mean(0, dtype=np.float64), frames.std(0, dtype=np.float64)
    feature = ",".join(f"{x:.4f}" for x in (*means, *spreads))
    row = {"n_bytes": n_bytes, "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-64:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature, "n_frames": len(mel), "n_tensors": len(kept), "tensors_sha256": hashlib.sha256(stored).hexdigest(), "n_segments": len(spans), "active_s": round(sum(b - a for a, b in spans), 6)}
    row["segments"] = [{"start_s": a, "end_s": b} for a, b in spans]
    if keep:
        row |= {"media": media, "features": stored}
    return row


def media_columns(df: DataFrame, keep: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the digests and segments (time spans); with keep also media (the file) and features (an Arrow stream of tensors and time spans)."""
    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rest = T._parse_datatype_string(DIGESTS + ", segments array<struct<start_s:double,end_s:double>>" + (", media binary, features binary" if keep else ""))
    schema = T.StructType([T.StructField("doc_id", source.schema["doc_id"].dataType), *rest.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                rows = [_row(t.as_py(), keep) for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[f.name] for r in rows], to_arrow_type(f.dataType)) for f in rest.fields)], schema.names)

    return source.mapInArrow(run, schema)
