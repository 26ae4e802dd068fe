"""Telephony audio in media columns: G.711 by lookup tables, IMA ADPCM with numpy across blocks.

``encode_wav`` and ``decode_wav`` handle 8-bit mu-law and A-law and 4-bit IMA ADPCM WAV files; ``store_pcm`` adds the
resampled PCM of a binary column of such files. Samples expand by table; ADPCM blocks of many files are decoded together,
one step for the k-th sample of all blocks; resampling is linear.

The query takes each text as the samples of a file of one of the three formats, by a checksum of the text, stores files and
PCM of the usual rate, and reads both back.

Edge cases: a null media value gives null columns; a file of no samples gives empty PCM; a file that is not a WAV, or
of another format, gives null and an ``error``. Repeated rows give equal results; added columns replace those of
their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import BATCH_BYTES, SCAN_ROWS, in_blocks, stored

MULAW, ALAW, IMA = 7, 6, 17
CODES, NAMES = (MULAW, ALAW, IMA), {MULAW: "ulaw", ALAW: "alaw", IMA: "ima"}
RATE, STORE_RATE = 8000, 16000
#: Bytes of an IMA block: a 4-byte header, then two samples a byte.
BLOCK = 192
#: Payload bytes that are expanded together.
PART_BYTES = 1 << 20
#: Whole PCM is several times its text; a higher level and larger pages than usual make up for part of that. Row groups are
#: in memory whole, so they are smaller than usual.
SMALL = {"parquet.compression.codec.zstd.level": "9", "parquet.page.size": str(4 << 20), "parquet.block.size": str(16 << 20)}
#: Media and PCM are large rows: few are decoded, and few go to a Python worker, together.
FEW = {BATCH_BYTES: str(8 << 20), SCAN_ROWS: "256"}
#: Packed PCM of at most so many values has a table of them.
FEW_VALUES = 80
#: Blocks decoded at once.
TOGETHER = 1 << 16

# Fixed values of the IMA ADPCM format.
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
     130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
     1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
     7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((code & 0x0F) << 3) + 0x84) << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    part, low = (code >> 4) & 7, (code & 0x0F) << 4
    size = np.where(part == 0, low + 8, (low + 0x108) << np.maximum(part - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


TABLES = {MULAW: _mulaw_table(), ALAW: _alaw_table()}


def decode_ima(data: bytes, block: int = BLOCK) -> np.ndarray:
    """PCM of mono IMA ADPCM blocks; a last block that is short is decoded as far as it goes."""
    whole, rest = divmod(len(data), block)
    out = [_ima_blocks(np.frombuffer(data, np.uint8, part * block, first * block).reshape(-1, block)) for first in range(0, whole, TOGETHER) for part in [min(TOGETHER, whole - first)]]
    if rest >= 4:
        out.append(_ima_blocks(np.frombuffer(data, np.uint8, rest, whole * block).reshape(1, -1)))
    return np.concatenate(out) if out else np.zeros(0, np.int16)


def _ima_moves() -> tuple[np.ndarray, np.ndarray]:
    """What a nibble adds to the sample and the step index it leads to, at ``16 * index + nibble``."""
    step, code = np.repeat(STEPS, 16), np.tile(np.arange(16, dtype=np.int32), len(STEPS))
    low = code & 7
    size = (step >> 3) + (step >> 2) * (low & 1) + (step >> 1) * ((low >> 1) & 1) + step * (low >> 2)
    index = np.clip(np.repeat(np.arange(len(STEPS), dtype=np.int32), 16) + INDEX_STEP[low], 0, len(STEPS) - 1)
    return np.where(code & 8, -size, size).astype(np.int32), 16 * index


ADDED, NEXT = _ima_moves()


def _ima_blocks(b: np.ndarray, by_block: bool = True) -> np.ndarray:
    """Samples of the blocks ``b`` (one a row): one after the other, or as a row for each sample place."""
    n = 1 + 2 * (b.shape[1] - 4)
    pcm = np.empty((n, b.shape[0]), np.int16)
    value = np.ascontiguousarray(b[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = 16 * np.minimum(b[:, 2], len(STEPS) - 1).astype(np.int32)
    codes = np.ascontiguousarray(b[:, 4:].T)
    pcm[0] = value
    for k in range(1, n):
        pair = codes[(k - 1) >> 1]
        move = index + (pair >> 4 if k % 2 == 0 else pair & 15)
        value += ADDED[move]
        np.clip(value, -32768, 32767, out=value)
        index = NEXT[move]
        pcm[k] = value
    return pcm.T.reshape(-1) if by_block else pcm


def encode_wav(payload: bytes, code: int = MULAW, rate: int = RATE) -> bytes:
    """A WAV file whose data chunk is ``payload``, taken as samples (or blocks) of the format ``code``."""
    align, bits = (BLOCK, 4) if code == IMA else (1, 8)
    extra = struct.pack("<HH", 2, 1 + 2 * (BLOCK - 4)) if code == IMA else struct.pack("<H", 0)
    second = rate * BLOCK // (1 + 2 * (BLOCK - 4)) if code == IMA else rate
    samples = len(payload) // BLOCK * (1 + 2 * (BLOCK - 4)) if code == IMA else len(payload)
    fmt = struct.pack("<HHIIHH", code, 1, rate, second, align, bits) + extra
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples)
    body += b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(wav: bytes) -> tuple[int, int, int, bytes]:
    """Format code, rate, block size and the bytes of the data chunk."""
    if wav[:4] != b"RIFF" or wav[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, fmt = 12, None
    while at + 8 <= len(wav):
        name, size = wav[at : at + 4], struct.unpack_from("<I", wav, at + 4)[0]
        if name == b"fmt ":
            code, channels, rate, _, align, _ = struct.unpack_from("<HHIIHH", wav, at + 8)
            if channels != 1:
                raise ValueError(f"{channels} channels; telephony has one")
            fmt = code, rate, align
        elif name == b"data":
            if fmt is None or at + 8 + size > len(wav):
                raise ValueError("a WAV without format, or cut off")
            return *fmt, wav[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def decode_wav(wav: bytes) -> tuple[int, np.ndarray]:
    (out,) = decode_wavs([wav])
    if isinstance(out, str):
        raise ValueError(out)
    return out


def decode_wavs(wavs: list[bytes]) -> list[tuple[int, np.ndarray] | str]:
    """Rate and PCM of each file, or what is wrong with it; ADPCM blocks of all files are decoded together."""
    out: list = [None] * len(wavs)
    blocks: dict[int, list[tuple[int, int, bytes]]] = {}
    for i, wav in enumerate(wavs):
        try:
            code, rate, align, payload = read_wav(wav)
            if code == IMA:
                if align <= 4:
                    raise ValueError(f"blocks of {align} bytes")
                blocks.setdefault(align, []).append((i, rate, payload))
            elif code in TABLES:
                out[i] = rate, TABLES[code][np.frombuffer(payload, np.uint8)]
            else:
                out[i] = f"WAV format {code}"
        except (ValueError, struct.error) as e:
            out[i] = str(e)
    for align, files in blocks.items():
        whole = [len(payload) // align * align for _, _, payload in files]
        pcm = decode_ima(b"".join(payload[:n] for (_, _, payload), n in zip(files, whole, strict=True)), align)
        ends = np.cumsum(whole) // align * (1 + 2 * (align - 4))
        for (i, rate, payload), n, own in zip(files, whole, np.split(pcm, ends[:-1]), strict=True):
            rest = decode_ima(payload[n:], align)
            out[i] = rate, np.concatenate([own, rest]) if len(rest) else own
    return out


def resample(pcm: np.ndarray, rate: int, to: int = STORE_RATE) -> np.ndarray:
    """Linear interpolation in integers, so that every machine has the same samples."""
    if rate == to or not len(pcm):
        return pcm
    at = np.arange(len(pcm) * to // rate, dtype=np.int64) * rate
    left, part = at // to, (at % to).astype(np.int32)
    low, high = pcm[left].astype(np.int32), pcm[np.minimum(left + 1, len(pcm) - 1)].astype(np.int32)
    return (low + (high - low) * part // to).astype(np.int16)


STORED = "pcm binary, pcm_rate int, pcm_samples bigint, error string"


def store_pcm(media: DataFrame, column: str = "media", rate: int = STORE_RATE, pack: bool = False) -> DataFrame:
    """``media`` with the 16-bit little-endian PCM of ``column``, resampled; ``pack``: as ``packed`` makes it."""
    added = [c.split()[0] for c in STORED.split(", ")]
    kept = [c for c in media.columns if c.lower() not in added]
    full = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in media.select(kept).schema), STORED])
    return media.mapInPandas(lambda frames: _with_pcm(frames, kept, column, rate, pack), full)


def _with_pcm(frames: Iterator[pd.DataFrame], kept: list[str], column: str, rate: int, pack: bool) -> Iterator[pd.DataFrame]:
    for frame in frames:
        first = 0
        for wavs in in_blocks(frame[column], lambda x: 1 + len(x or b""), PART_BYTES):
            rows = iter(decode_wavs([bytes(x) for x in wavs if x is not None]))
            made = []
            for wav in wavs:
                found = (None, None) if wav is None else next(rows)
                if isinstance(found, str):
                    made.append((None, None, None, found))
                elif found[1] is None:
                    made.append((None, None, None, None))
                else:
                    pcm = resample(found[1], found[0], rate)
                    raw = pcm.astype("<i2").tobytes()
                    made.append((packed(raw) if pack else raw, rate, len(pcm), None))
            part = frame.iloc[first : first + len(wavs)]
            first += len(wavs)
            own = pd.DataFrame(made, columns=[c.split()[0] for c in STORED.split(", ")], index=part.index, dtype=object)
            yield pd.concat([part[kept], own.astype({"pcm_rate": "Int32", "pcm_samples": "Int64"})], axis=1)


def feature(name: str, pcm: bytes) -> str:
    """Format, samples, level, peak, zero crossings and checksum of stored PCM."""
    x = np.frombuffer(pcm, "<i2").astype(np.int32)
    low = x < 0
    size = np.abs(x)
    return f"{name}:{len(x)}:{int(size.sum(dtype=np.int64))}:{int(size.max(initial=0))}:{int((low[1:] != low[:-1]).sum())}:{zlib.crc32(pcm)}"


#: Samples, kept differences of odd ones, values in the table.
HEAD = struct.Struct("<QQB")


def packed(pcm: bytes) -> bytes:
    """PCM as its even samples and what its odd ones differ by from the mean of their neighbours: without loss, and
    little to store of what was interpolated.

    Differences end at the last that is not 0. Even samples of few values are places in a table of these, others what they
    differ by from the one before."""
    x = np.frombuffer(pcm, "<i2")
    even, odd = np.ascontiguousarray(x[::2]), x[1::2].astype(np.int32)
    rest = (odd - _means(even, len(odd))).astype("<i2")
    rest = rest[: np.flatnonzero(rest)[-1] + 1] if rest.any() else rest[:0]
    place = np.zeros(1 << 16, np.uint8)
    place[even.view("<u2")] = 1
    values = np.flatnonzero(place)
    if len(values) > FEW_VALUES:
        return b"".join([HEAD.pack(len(x), len(rest), 0), np.diff(even, prepend=np.int16(0)).astype("<i2").tobytes(), rest.tobytes()])
    place[values] = np.arange(len(values))
    return b"".join([HEAD.pack(len(x), len(rest), len(values)), values.astype("<u2").tobytes(), place[even.view("<u2")].tobytes(), rest.tobytes()])


def unpacked(raw: bytes) -> bytes:
    n, k, values = HEAD.unpack_from(raw)
    n_even, at = (n + 1) // 2, HEAD.size + 2 * values
    if values:
        even = np.frombuffer(raw, "<i2", values, HEAD.size)[np.frombuffer(raw, np.uint8, n_even, at)]
    else:
        even = np.cumsum(np.frombuffer(raw, "<i2", n_even, at), dtype=np.int16)
    odd = _means(even, n // 2)
    odd[:k] += np.frombuffer(raw, "<i2", k, len(raw) - 2 * k)
    out = np.empty(n, "<i2")
    out[::2], out[1::2] = even, odd.astype("<i2")
    return out.tobytes()


def _means(even: np.ndarray, n: int) -> np.ndarray:
    low = even[:n].astype(np.int32)
    high = np.append(even[1:], even[-1:])[:n].astype(np.int32)
    return low + ((high - low) >> 1)


MEDIA = "doc_id bigint, n_bytes bigint, media binary"
RESULT = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * (-len(raw) % BLOCK or (0 if raw else BLOCK))


def _whole(x) -> int | None:
    return None if pd.isna(x) else int(x)


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")], dtype=object)
    return out.astype({c.split()[0]: "Int64" for c in schema.split(", ") if c.endswith("bigint")})


def text_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each text as the samples (or blocks) of a WAV file in the column ``media``."""
    return _texts(docs, text).mapInPandas(_media, MEDIA)


def text_pcm(docs: DataFrame, text: str = "text", rate: int = STORE_RATE, pack: bool = False) -> DataFrame:
    """``store_pcm`` of ``text_media``, both in one Python worker; files of one format come together, which compress better so."""
    kept = [c.split()[0] for c in MEDIA.split(", ")]
    return _texts(docs, text).mapInPandas(lambda frames: _with_pcm(_media(frames, together=True), kept, "media", rate, pack), f"{MEDIA}, {STORED}")


def _texts(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs[text].cast("string").alias(text))


def _code(payload: bytes) -> int:
    return CODES[zlib.crc32(payload) % len(CODES)]


def _media(frames: Iterator[pd.DataFrame], together: bool = False) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = frame.itertuples(index=False)
        for part in in_blocks(sorted(rows, key=lambda r: _code(padded(r[1])[1])) if together else rows, lambda r: len(r[1] or ""), PART_BYTES):
            made = [(doc_id, *padded(t)) for doc_id, t in part]
            yield _frame([(_whole(doc_id), n, encode_wav(payload, _code(payload))) for doc_id, n, payload in made], MEDIA)


def measure(media: DataFrame, pack: bool = False) -> DataFrame:
    """Digests of stored media and features of their stored PCM, from the bytes read back; ``pack``: PCM is packed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in in_blocks(frame.itertuples(index=False), lambda r: len(r[2]), PART_BYTES):
                rows = []
                for doc_id, n, wav, pcm in part:
                    wav = bytes(wav)
                    code, _, _, back = read_wav(wav)
                    rows.append((_whole(doc_id), _whole(n), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(wav), hashlib.sha256(wav).hexdigest(), feature(NAMES[code], unpacked(pcm) if pack else bytes(pcm))))
                yield _frame(rows, RESULT)

    return media.select("doc_id", "n_bytes", "media", "pcm").mapInPandas(run, RESULT)


def op6_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = text_pcm(spark.read.parquet(f"{sf_dir}/documents.parquet"), pack=True)
    kept = stored(media, "media", codec="zstd", options=SMALL, confs=FEW)
    # stored as well, since batches are as few rows as here only while this runs
    return stored(measure(kept, pack=True), "measured", codec="zstd", confs=FEW)
