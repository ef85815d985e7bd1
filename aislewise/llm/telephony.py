"""Telephony audio: companded and ADPCM speech as WAV bytes, expanded, resampled and stored as PCM.

Mu-law and A-law samples expand through a 256-entry table.  ADPCM blocks are independent, so
the decoder steps through sample positions once and works on all blocks of a batch at each step.
Tracks are stored whole beside the media, in a lossless code of their own samples: every other sample as it is,
those between as differences from a filter fitted to the tracks.  A track comes back from its own bytes;
neither the media nor the resampler is asked for it.
No shuffle, one scan in, one table out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislewise.llm.common import map_batches, record, runs, slices, stored, utf8

# Fixed values of the formats: WAV codes, and IMA ADPCM's index steps (its step sizes follow a rule).
PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 0x11
CODECS = (MULAW, ALAW, ADPCM)
INDEX_STEPS = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
STEP_SIZES = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107,
    118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963,
    1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894,
    6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794,
    32767,
]
BLOCK = 64  # bytes of an ADPCM block: 4 of header, then two samples a byte
PER_BLOCK = 2 * (BLOCK - 4) + 1
UNIT = float(1 << 30)  # of a filter's whole numbers
DENSE = (1 << 32) - 1  # a track's number of corrections, if there is one a sample
TAPS, BEFORE = 8, 3  # samples a packed track's filter looks at, and how many of them before the place
PACKED = {"parquet.compression.codec.zstd.level": "6", "parquet.page.size": str(4 << 20)}


@lru_cache(maxsize=2)
def expansion(codec: int) -> np.ndarray:
    """The 256 linear values of mu-law or A-law."""
    code = np.arange(256, dtype=np.int32)
    if codec == MULAW:
        code = ~code & 0xFF
        value = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
        return np.where(code & 128, -value, value).astype(np.int16)
    code ^= 0x55
    part, low = code >> 4 & 7, (code & 15) << 4
    value = np.where(part == 0, low + 8, low + 264 << np.maximum(part - 1, 0))
    return np.where(code & 128, value, -value).astype(np.int16)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(n, PER_BLOCK) samples of (n, BLOCK) bytes.  A step index above the table counts as its last."""
    sizes = np.array(STEP_SIZES, np.int32)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(sizes) - 1)
    out = np.empty((len(blocks), PER_BLOCK), np.int16)
    out[:, 0] = value
    for k in range(1, PER_BLOCK):
        byte = blocks[:, 4 + (k - 1) // 2]
        nibble = (byte >> 4 if k % 2 == 0 else byte & 15).astype(np.int32)
        step = sizes[index]
        change = (step >> 3) + (step >> 2) * (nibble & 1) + (step >> 1) * (nibble >> 1 & 1) + step * (nibble >> 2 & 1)
        value = np.clip(np.where(nibble & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + INDEX_STEPS[nibble], 0, len(sizes) - 1)
        out[:, k] = value
    return out


def wav(codec: int, payload: bytes, rate: int = 8000) -> bytes:
    """A mono WAV file around ``payload``, whose bytes stand in it unchanged."""
    block, bits = (BLOCK, 4) if codec == ADPCM else (2, 16) if codec == PCM else (1, 8)
    per_second = rate * BLOCK // PER_BLOCK if codec == ADPCM else rate * block
    fmt = struct.pack("<HHIIHH", codec, 1, rate, per_second, block, bits)
    fmt += struct.pack("<HH", 2, PER_BLOCK) if codec == ADPCM else b"" if codec == PCM else struct.pack("<H", 0)
    fact = len(payload) // BLOCK * PER_BLOCK if codec == ADPCM else len(payload) // block
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt
    body += b"fact" + struct.pack("<II", 4, fact) + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(body)) + body


def chunks(file: bytes) -> dict[bytes, bytes]:
    """The chunks of a WAV file by name."""
    out, at = {}, 12
    while at + 8 <= len(file):
        n = int.from_bytes(file[at + 4 : at + 8], "little")
        out[file[at : at + 4]] = file[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    return out


def unwav(file: bytes) -> tuple[int, int, bytes]:
    """Codec, rate and sample bytes of a WAV file."""
    parts = chunks(file)
    if b"data" not in parts:
        raise ValueError("no sample data in the file")
    codec, _, rate = struct.unpack_from("<HHI", parts.get(b"fmt ", struct.pack("<HHI", PCM, 1, 8000)))
    return codec, rate, parts[b"data"]


def to_pcm(files: list[tuple[int, int, bytes]]) -> list[np.ndarray]:
    """Linear samples of each (codec, rate, sample bytes); all ADPCM blocks are decoded together."""
    blocks = [np.frombuffer(d, np.uint8)[: len(d) // BLOCK * BLOCK].reshape(-1, BLOCK) for c, _, d in files if c == ADPCM]
    if blocks:
        cuts = np.cumsum([len(b) for b in blocks])[:-1]
        decoded = iter(np.split(decode_adpcm(np.concatenate(blocks)), cuts))
    out = []
    for codec, _, data in files:
        if codec == ADPCM:
            out.append(next(decoded).reshape(-1))
        elif codec == PCM:
            out.append(np.frombuffer(data, "<i2"))
        else:
            out.append(expansion(codec)[np.frombuffer(data, np.uint8)])
    return out


@lru_cache(maxsize=16)
def _filters(up: int, down: int, half: int) -> np.ndarray:
    """Windowed-sinc low-pass filters of unit sum; row f is for outputs f/up samples after an input sample."""
    wide = max(1.0, down / up)  # of a lobe, in input samples
    reach = int(np.ceil(half * wide))
    away = (np.arange(-reach, reach + 2) - np.arange(up)[:, None] / up) / wide
    rows = np.sinc(away) * np.where(np.abs(away) < half, 0.5 + 0.5 * np.cos(np.pi * away / half), 0)
    return rows / rows.sum(1, keepdims=True)


def _polyphase(pcm: np.ndarray, up: int, down: int, rows: np.ndarray) -> np.ndarray:
    """Sums of the filters ``rows`` over ``pcm``, in their type; silence continues it at both ends."""
    width = rows.shape[1]
    n = -(-len(pcm) * up // down)
    padded = np.zeros(len(pcm) + 2 * width + down, rows.dtype)
    padded[width // 2 - 1 : width // 2 - 1 + len(pcm)] = pcm
    windows = np.lib.stride_tricks.sliding_window_view(padded, width)
    out = np.empty(n, rows.dtype)
    for phase in range(min(up, n)):
        at = len(range(phase, n, up))
        out[phase::up] = windows[phase * down // up :: down][:at] @ rows[phase * down % up]
    return out


def _steps(source: int, target: int) -> tuple[int, int]:
    return target // gcd(source, target), source // gcd(source, target)


def resample(pcm: np.ndarray, source: int, target: int, half: int = 4) -> np.ndarray:
    """``pcm`` at another rate, by a polyphase filter; silence continues it at both ends."""
    up, down = _steps(source, target)
    if up == down or not len(pcm):
        return pcm.astype(np.int16)
    out = _polyphase(pcm, up, down, _filters(up, down, half).astype(np.float32))
    return np.clip(np.rint(out), -32768, 32767).astype(np.int16)


def predicted(core: np.ndarray, source: int, target: int, half: int = 4) -> np.ndarray:
    """What a track is taken to be from its core: filters in whole numbers, the same on every machine.

    Sums stay below 2 ** 53, so that doubles hold them exactly in any order.
    """
    up, down = _steps(source, target)
    if up == down or not len(core):
        return core.astype(np.int16)
    out = _polyphase(core, up, down, np.rint(_filters(up, down, half) * UNIT))
    return np.clip(np.floor(out / UNIT + 0.5), -32768, 32767).astype(np.int16)


def layered(codec: int, rate: int, payload: bytes, core: np.ndarray, track: np.ndarray, track_rate: int) -> bytes:
    """A lossless file of ``track``: a WAV file of its core, and a chunk of rate, length and corrections.

    ``core`` are the linear samples of ``payload``.  Corrections are places and values, or one a sample.
    """
    guess = predicted(core, rate, track_rate)
    if len(guess) != len(track):
        raise ValueError("the track is not as long as its core")
    wrong = track - guess  # wraps around, as the sum of the reader does
    at = np.flatnonzero(wrong)
    sparse = 6 * len(at) < 2 * len(track)
    body = at.astype("<u4").tobytes() + wrong[at].astype("<i2").tobytes() if sparse else wrong.astype("<i2").tobytes()
    extra = struct.pack("<III", track_rate, len(track), len(at) if sparse else DENSE) + body
    file = wav(codec, payload, rate)[8:] + b"corr" + struct.pack("<I", len(extra)) + extra
    return b"RIFF" + struct.pack("<I", len(file)) + file


def unlayered(files: list[bytes]) -> list[tuple[int, np.ndarray]]:
    """Rate and samples of each ``layered`` track."""
    out = []
    cores = [unwav(f) for f in files]
    for (_, rate, _), core, file in zip(cores, to_pcm(cores), files, strict=True):
        extra = chunks(file)[b"corr"]
        track_rate, length, wrong = struct.unpack_from("<III", extra)
        track = predicted(core, rate, track_rate)
        if len(track) != length:
            raise ValueError("the track is not as long as its core")
        if wrong == DENSE:
            track = track + np.frombuffer(extra, "<i2", length, 12)
        else:
            track[np.frombuffer(extra, "<u4", wrong, 12)] += np.frombuffer(extra, "<i2", wrong, 12 + 4 * wrong)
        out.append((track_rate, track))
    return out


def _guess(even: np.ndarray, filt: np.ndarray, n: int) -> np.ndarray:
    """``n`` samples that the filter puts between those of ``even``; whole sums below 2 ** 53, as in ``predicted``."""
    padded = np.zeros(len(even) + TAPS, np.float64)
    padded[BEFORE : BEFORE + len(even)] = even
    out = np.correlate(padded, filt.astype(np.float64), "valid")[:n]
    return np.clip(np.floor(out / UNIT + 0.5), -32768, 32767).astype(np.int16)


def fitted(tracks: list[np.ndarray]) -> np.ndarray:
    """The whole-number filter that best gives the odd samples of ``tracks`` from the even ones, by least squares."""
    square, right = np.zeros((TAPS, TAPS)), np.zeros(TAPS)
    for t in tracks:
        padded = np.zeros(len(t) - len(t) // 2 + TAPS, np.float64)
        padded[BEFORE : BEFORE + len(t) - len(t) // 2] = t[::2]
        free = np.abs(t[1::2].astype(np.int32)) < 32767  # clipped samples say nothing of the filter
        windows = np.lib.stride_tricks.sliding_window_view(padded, TAPS)[: len(t) // 2][free]
        square += windows.T @ windows
        right += windows.T @ t[1::2][free]
    best = np.linalg.lstsq(square, right, rcond=1e-13)[0]
    return np.clip(np.rint(best * UNIT), -(1 << 31), (1 << 31) - 1).astype("<i4")


def pack_tracks(tracks: list[np.ndarray], rate: int) -> list[bytes]:
    """A lossless file of each track: rate, length, filter, even samples, and what the odd ones differ from the filter's.

    Even samples are places in a table of their values where all tracks together have 256 values at most.
    Filter and table are common to the tracks, but every file holds both and is read alone.
    """
    filt = fitted(tracks)
    seen = np.zeros(1 << 16, bool)
    for t in tracks:
        seen[t[::2].view(np.uint16)] = True
    table = np.flatnonzero(seen).astype("<u2") if np.count_nonzero(seen) <= 256 else np.empty(0, "<u2")
    place = (np.cumsum(seen) - 1).astype(np.uint8)
    out = []
    for t in tracks:
        even = np.ascontiguousarray(t[::2])
        wrong = t[1::2] - _guess(even, filt, len(t) // 2)  # wraps around, as the sum of the reader does
        narrow = not len(wrong) or -128 <= wrong.min() <= wrong.max() <= 127
        head = struct.pack("<4sIIHH", b"trk1", rate, len(t), len(table), 1 if narrow else 2) + filt.tobytes() + table.tobytes()
        body = place[even.view(np.uint16)] if len(table) else even.astype("<i2")
        out.append(head + body.tobytes() + wrong.astype("i1" if narrow else "<i2").tobytes())
    return out


def unpack_track(file: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples of one file of ``pack_tracks``."""
    mark, rate, length, values, width = struct.unpack_from("<4sIIHH", file)
    if mark != b"trk1":
        raise ValueError("not a packed track")
    at = 16 + 4 * TAPS
    filt, table = np.frombuffer(file, "<i4", TAPS, 16), np.frombuffer(file, "<u2", values, at)
    at += 2 * values
    half = length // 2
    even = table[np.frombuffer(file, np.uint8, length - half, at)].view("<i2") if values else np.frombuffer(file, "<i2", length - half, at)
    at += (length - half) * (1 if values else 2)
    out = np.empty(length, np.int16)
    out[::2] = even
    out[1::2] = _guess(even, filt, half) + np.frombuffer(file, "i1" if width == 1 else "<i2", half, at).astype(np.int16)
    return rate, out


def feature(codec: int, rate: int, pcm: np.ndarray) -> str:
    """Codec, rate, length, loudness, peak, sign changes and checksum of a stored track."""
    wide = pcm.astype(np.int64)
    rms = int(np.sqrt((wide * wide).mean())) if len(pcm) else 0
    crossings = int(np.count_nonzero(np.diff(np.signbit(pcm)))) if len(pcm) else 0
    peak = int(np.abs(wide).max()) if len(pcm) else 0
    return f"{codec}/{rate}/{len(pcm)}/{rms}/{peak}/{crossings}/{zlib.crc32(pcm.tobytes()):08x}"


def payload_of(raw: bytes, unit: int = BLOCK) -> bytes:
    """``raw`` and zeros up to a positive multiple of ``unit``."""
    return raw + bytes(max(unit, -(-len(raw) // unit) * unit) - len(raw))


MEDIA = "doc_id long, n_bytes long, files array<binary>"


def store_media(docs: DataFrame, rate: int, track_rate: int) -> DataFrame:
    """A table with two files a row: a WAV file made of the whole text, and its decoded track at ``track_rate``.

    The payload's checksum picks the codec, so equal texts are stored alike.  A null text is empty.  The
    files of a row stand side by side, so what the track's core repeats takes next to no room.
    """

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                raw = utf8(batch.column("text"))
                payloads = [payload_of(r) for r in raw]
                parts = [(CODECS[zlib.crc32(p) % len(CODECS)], rate, p) for p in payloads]
                files = []
                for (codec, hz, data), core in zip(parts, to_pcm(parts), strict=True):
                    track = resample(core, hz, track_rate)
                    files.append([wav(codec, data, hz), layered(codec, hz, data, core, track, track_rate)])
                yield record(
                    {
                        "doc_id": (batch.column("doc_id"), pa.int64()),
                        "n_bytes": ([len(r) for r in raw], pa.int64()),
                        "files": (files, pa.list_(pa.binary())),
                    }
                )

    return stored(map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, MEDIA), "telephony")


STORED = "doc_id long, n_bytes long, media binary, track binary"


def store_tracks(docs: DataFrame, rate: int, track_rate: int) -> DataFrame:
    """A table of WAV files made of whole texts, and of their decoded tracks at ``track_rate``, packed.

    Rows of a run stand in order of their codecs; otherwise as ``store_media``.
    """

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                raw = utf8(batch.column("text"))
                payloads = [payload_of(r) for r in raw]
                codecs = [CODECS[zlib.crc32(p) % len(CODECS)] for p in payloads]
                for codec in CODECS:
                    rows = [k for k, c in enumerate(codecs) if c == codec]
                    if not rows:
                        continue
                    cores = to_pcm([(codec, rate, payloads[k]) for k in rows])
                    tracks = pack_tracks([resample(x, rate, track_rate) for x in cores], track_rate)
                    yield record(
                        {
                            "doc_id": (batch.column("doc_id").take(pa.array(rows)), pa.int64()),
                            "n_bytes": ([len(raw[k]) for k in rows], pa.int64()),
                            "media": ([wav(codec, payloads[k], rate) for k in rows], pa.binary()),
                            "track": (tracks, pa.binary()),
                        }
                    )

    return stored(map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, STORED), "telephony", **PACKED)


DIGESTS = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long,"
    " media_bytes long, media_sha256 string, feature string"
)


def media_digests(media: DataFrame) -> DataFrame:
    """Digests of stored WAV files and features of their stored tracks, all from the bytes read back."""

    def run(batches):
        for whole in batches:
            for batch in runs(whole, whole.column("n_bytes").to_pylist(), 2 << 20):
                files = batch.column("media").to_pylist()
                parts, tracks = [unwav(f) for f in files], [unpack_track(t) for t in batch.column("track").to_pylist()]
                yield record(
                    {
                        "doc_id": (batch.column("doc_id"), pa.int64()),
                        "n_bytes": (batch.column("n_bytes"), pa.int64()),
                        "payload_bytes": ([len(p[2]) for p in parts], pa.int64()),
                        "payload_sha256": ([hashlib.sha256(p[2]).hexdigest() for p in parts], pa.string()),
                        "tail_crc32": ([zlib.crc32(p[2][-64:]) for p in parts], pa.int64()),
                        "media_bytes": ([len(f) for f in files], pa.int64()),
                        "media_sha256": ([hashlib.sha256(f).hexdigest() for f in files], pa.string()),
                        "feature": (
                            [feature(p[0], *t) for p, t in zip(parts, tracks, strict=True)],
                            pa.string(),
                        ),
                    }
                )

    return map_batches(media, run, DIGESTS)


def telephony(docs: DataFrame, rate: int = 8000, track_rate: int = 16000) -> DataFrame:
    """Whole texts as telephony audio: stored, read back, digested.  One row per row of ``docs``.

    Null and empty texts give 64 zero bytes.  Repeated rows and ids stay apart, null ids stay null,
    an empty table gives no row, further columns of any name are ignored.
    """
    return media_digests(store_tracks(docs, rate, track_rate))
