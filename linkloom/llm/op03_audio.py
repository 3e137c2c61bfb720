"""Audio features of a media column: resampling, log-mel filterbanks, energy segments, as fixed-shape tensors.

A media value is binary: a RIFF/WAVE file of PCM (8, 16, 24 or 32 bits) or floats (32 or 64 bits), its format
plain or extensible, mono or more channels, which are averaged, or, without that header, raw
unsigned 8-bit mono samples at ``rate``. It is resampled to ``target`` by a polyphase filter (one windowed-sinc filter per
phase, so only wanted samples are computed), cut into overlapping frames, and each frame gives the logs of its mel
filterbank energies. Frames are stored in tensors of a fixed shape (``frames`` x ``mels``, the last one padded by silence)
with the time span of their samples. Segments of sound are found by hysteresis: one begins where a frame's energy rises above
the upper threshold and ends where it falls below the lower one; the thresholds lie relative to the loudest frame.

Defined results: a null or empty value, one of a WAVE header without samples, and one that is no readable PCM (a broken
header, another coding) have one row without tensor, with zero frames, samples and seconds, and ``error`` says which: null,
empty, no samples, unreadable. A value shorter than a frame is padded to one.
Repeated rows are computed each. Null ids stay null. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ROWS = "{id} long, part int, begin_s double, end_s double, frames int, tensor array<float>, segments array<struct<begin_s:double,end_s:double>>, error string"

#: By format and bits, numpy's type; and how the GUID of an extensible header's format goes on after the format's number.
_READ = {(1, 8): "u1", (1, 16): "<i2", (1, 24): "", (1, 32): "<i4", (3, 32): "<f4", (3, 64): "<f8"}
_SUBFORMAT = bytes.fromhex("000000001000800000aa00389b71")


@dataclass(frozen=True)
class Rules:
    """rate: of values without a header. target: resampled to. window, hop: samples of a frame and between frames. mels: bands.
    frames: of a tensor. upper, lower: thresholds in dB below the loudest frame. least: frames of a segment. taps: of the
    filter, on each side, in zero crossings."""

    rate: int = 44_100
    target: int = 16_000
    window: int = 400
    hop: int = 160
    mels: int = 40
    frames: int = 100
    upper: float = 6.0
    lower: float = 12.0
    least: int = 3
    taps: int = 8


def samples(raw: bytes | None, rate: int) -> tuple[np.ndarray, int]:
    """Samples in -1..1 of a media value, and their rate; none if it can't be read."""
    none = np.zeros(0, np.float32)
    if not raw:
        return none, rate
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        return (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128, rate
    at, shape = 12, None
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        if name == b"fmt " and at + 24 <= len(raw):
            kind, channels, own, _, _, bits = struct.unpack_from("<HHIIHH", raw, at + 8)
            if kind == 0xFFFE and size >= 40 and at + 48 <= len(raw) and raw[at + 34 : at + 48] == _SUBFORMAT:  # extensible
                kind = struct.unpack_from("<H", raw, at + 32)[0]
            shape = (channels, own, kind, bits) if channels and own and (kind, bits) in _READ else None
        elif name == b"data" and shape:
            channels, own, kind, bits = shape
            data = raw[at + 8 : at + 8 + size]
            data = data[: len(data) // (bits // 8 * channels) * (bits // 8 * channels)]
            if bits == 24:  # as the upper bytes of 32 bits
                wide = np.zeros((len(data) // 3, 4), np.uint8)
                wide[:, 1:] = np.frombuffer(data, np.uint8).reshape(-1, 3)
                data, bits = wide.tobytes(), 32
            found = np.frombuffer(data, _READ[kind, bits]).astype(np.float64)
            if kind == 3:
                found = np.clip(np.nan_to_num(found, nan=0.0), -1, 1)
            else:
                found = (found - 128) / 128 if bits == 8 else found / (1 << bits - 1)
            return found.reshape(-1, channels).mean(axis=1).astype(np.float32), own
        at += 8 + size + size % 2
    return none, rate


@cache
def phases(up: int, down: int, taps: int) -> np.ndarray:
    """The filter of each phase (up x taps): a sinc below both Nyquist rates under a Hann window; each sums to 1."""
    cutoff = min(1.0, up / down)
    half = int(np.ceil(taps / cutoff))
    at = np.arange(-half + 1, half + 1)[None, :] - np.arange(up)[:, None] / up
    bank = np.sinc(at * cutoff) * np.where(abs(at) < half, 0.5 + 0.5 * np.cos(np.pi * at / half), 0)
    return (bank / bank.sum(axis=1, keepdims=True)).astype(np.float32)


def resample(x: np.ndarray, rate: int, target: int, taps: int) -> np.ndarray:
    """``x`` at ``target``: output n is at input n * down / up, of phase n * down mod up."""
    if rate == target or len(x) == 0:
        return x
    common = gcd(rate, target)
    up, down = target // common, rate // common
    bank = phases(up, down, taps)
    half = bank.shape[1] // 2
    n = -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(half - 1, np.float32), x, np.zeros(half + 1, np.float32)])
    view = np.lib.stride_tricks.sliding_window_view(padded, bank.shape[1])
    out = np.empty(n, np.float32)
    if n >= 4 * up:  # phase by phase: outputs of a phase lie ``down`` inputs apart
        for p in range(up):
            first = p * down // up
            own = view[first::down]
            count = -(-(n - p) // up)
            out[p::up] = own[:count] @ bank[p * down % up]
    else:
        at = np.arange(n) * down
        out[:] = np.einsum("ij,ij->i", view[at // up], bank[at % up])
    return out


@cache
def filterbank(rate: int, size: int, mels: int) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale up to half the rate: (size/2 + 1) x mels."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    at = np.linspace(0, rate / 2, size // 2 + 1)[:, None]
    rise = (at - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - at) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def fault(raw: bytes | None, n: int) -> str | None:
    """Why a value of n samples has none."""
    if n or raw is None:
        return None
    if not raw:
        return "empty"
    found = raw[:4] == b"RIFF" and raw[8:12] == b"WAVE" and b"data" in raw
    return "no samples" if found and raw.endswith(b"data\x00\x00\x00\x00") else "unreadable"


_SILENCE = np.log(np.float32(1e-6))


def spectrum(x: np.ndarray, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies (frames x mels) and the energy of each frame in dB."""
    if len(x) == 0:
        return np.zeros((0, rules.mels), np.float32), np.zeros(0)
    n = 1 + max(0, -(-(len(x) - rules.window) // rules.hop))
    x = np.append(x, np.zeros(max(0, (n - 1) * rules.hop + rules.window - len(x)), np.float32))
    view = np.lib.stride_tricks.sliding_window_view(x, rules.window)[:: rules.hop][:n]
    size = 1 << (rules.window - 1).bit_length()
    shape = np.hanning(rules.window + 1)[:-1].astype(np.float32)
    bank = filterbank(rules.target, size, rules.mels)
    out, energy = np.empty((n, rules.mels), np.float32), np.empty(n)
    for a in range(0, n, 2048):
        part = view[a : a + 2048]
        power = np.abs(np.fft.rfft(part * shape, size)) ** 2
        out[a : a + 2048] = np.log(power.astype(np.float32) @ bank + np.float32(1e-6))  # never below _SILENCE
        energy[a : a + 2048] = 10 * np.log10((part**2).mean(axis=1) + 1e-10)
    return out, energy


def segments(energy: np.ndarray, upper: float, lower: float, least: int) -> list[tuple[int, int]]:
    """Runs of frames (begin, end): entered at ``upper`` dB or more, left below ``lower``; at least ``least`` frames."""
    event = np.where(energy >= upper, 1, np.where(energy < lower, -1, 0))
    last = np.maximum.accumulate(np.where(event != 0, np.arange(len(event)), -1))
    on = np.where(last >= 0, event[last], -1) > 0
    edge = np.diff(np.concatenate([[0], on.astype(np.int8), [0]]))
    return [(int(a), int(b)) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)) if b - a >= least]


def features(raw: bytes | None, rules: Rules) -> tuple[np.ndarray, list[tuple[int, int]], int]:
    """Log-mel frames, segments and how many samples a media value has at the target rate."""
    x, rate = samples(raw, rules.rate)
    x = resample(x, rate, rules.target, rules.taps)
    mel, energy = spectrum(x, rules)
    loud = energy.max() if len(energy) else 0.0
    return mel, segments(energy, loud - rules.upper, loud - rules.lower, rules.least), len(x)


def audio(media: DataFrame, column: str, rules: Rules = Rules(), id_column: str = "doc_id") -> DataFrame:
    """One row per tensor: the id, part (from 0), begin_s and end_s (of its samples), frames (before padding), tensor (row by
    row), and the segments that begin in it."""
    schema = _ROWS.format(id=f"`{id_column}`")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held, size = batch.column(0), [], 0
            for k, value in enumerate(batch.column(1)):
                raw = value.as_buffer()
                own = raw.to_pybytes() if raw is not None else (b"" if value.is_valid else None)
                mel, spans, n = features(own, rules)
                held.append((k, mel, spans, n, fault(own, n)))
                size += mel.size
                if size > 1 << 22:
                    yield _tensors(ids, held, rules, id_column)
                    held, size = [], 0
            if held:
                yield _tensors(ids, held, rules, id_column)

    return media.select(F.col(id_column).cast("long").alias(id_column), F.col(column).cast("binary").alias(column)).mapInArrow(run, schema)


def _tensors(ids: pa.Array, held: list, rules: Rules, id_column: str) -> pa.RecordBatch:
    step, rate = rules.frames, rules.target
    owner, part, begin, end, frames, blocks, spans, faults = [], [], [], [], [], [], [], []
    for k, mel, found, n, error in held:
        parts = max(1, -(-len(mel) // step))
        padded = np.full((parts * step if len(mel) else 0, rules.mels), _SILENCE, np.float32)
        padded[: len(mel)] = mel
        blocks.append(padded.ravel())
        for j in range(parts):
            own = min(step, len(mel) - j * step)
            owner.append(k)
            faults.append(error)
            part.append(j)
            begin.append(j * step * rules.hop / rate)
            end.append(min(n, (j * step + max(0, own - 1)) * rules.hop + rules.window) / rate if own else 0.0)
            frames.append(own)
            spans.append([{"begin_s": a * rules.hop / rate, "end_s": min(n, (b - 1) * rules.hop + rules.window) / rate} for a, b in found if j * step <= a < (j + 1) * step])
    full = np.array(frames) > 0
    offsets = np.append(0, np.cumsum(full * (step * rules.mels)))
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=np.append(~full, False)), pa.array(np.concatenate(blocks)))
    span = pa.list_(pa.struct([("begin_s", pa.float64()), ("end_s", pa.float64())]))
    columns = [ids.take(pa.array(owner)), pa.array(part, pa.int32()), pa.array(begin), pa.array(end), pa.array(frames, pa.int32()), lists, pa.array(spans, span), pa.array(faults, pa.string())]
    return pa.RecordBatch.from_arrays(columns, [id_column, "part", "begin_s", "end_s", "frames", "tensor", "segments", "error"])


def fixed_shape(table: pa.Table, rules: Rules = Rules()) -> pa.Table:
    """Rows of ``audio`` (as of ``DataFrame.toArrow``) with the tensor as a column of Arrow's fixed-shape tensor type."""
    kind = pa.fixed_shape_tensor(pa.float32(), [rules.frames, rules.mels], dim_names=["frame", "mel"])
    at = table.schema.get_field_index("tensor")
    plain = table.column(at).combine_chunks().cast(pa.list_(pa.float32(), rules.frames * rules.mels))
    return table.set_column(at, pa.field("tensor", kind), pa.ExtensionArray.from_storage(kind, plain))


def store(rows: DataFrame, path: str, rules: Rules = Rules()) -> DataFrame:
    """Write rows of ``audio`` to Parquet files of fixed-shape tensors in the folder ``path``, which all executors share (a
    mounted path, or any that Arrow's filesystems know); a repeated task writes the same name again. What was written:
    file, rows."""
    from pyarrow import fs
    from pyspark import TaskContext

    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        where, folder = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        where.create_dir(folder, recursive=True)
        name, writer, n = f"{folder.rstrip('/')}/part-{TaskContext.get().partitionId():05d}.parquet", None, 0
        for batch in batches:
            table = fixed_shape(pa.Table.from_batches([batch]).rename_columns(names), rules)
            writer = writer or pq.ParquetWriter(name, table.schema, filesystem=where)
            writer.write_table(table)
            n += len(table)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["file", "rows"])

    return rows.mapInArrow(run, "file string, rows long")
