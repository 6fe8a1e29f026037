"""Arrays of samples, probabilities and tokens as Column expressions, and PCM bytes."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F


def root_mean_square(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / F.size(x))


def normalized(x: Column, target: float, least: float = 1e-6) -> Column:
    """Samples scaled to a root mean square of ``target`` and kept within -1..1; silence stays as it is."""
    level = root_mean_square(x)
    return F.when(level > least, F.transform(x, lambda v: F.least(F.lit(1.0), F.greatest(F.lit(-1.0), v * F.lit(target) / level)))).otherwise(x)


def resampled(x: Column, step: float) -> Column:
    """Values at 0, step, 2 * step, ... by straight lines between samples."""
    last = F.size(x) - 1
    places = F.transform(F.sequence(F.lit(0), F.floor(last / F.lit(step)).cast("int")), lambda i: i * F.lit(step))
    left = lambda p: F.floor(p).cast("int")
    return F.transform(places, lambda p: F.get(x, left(p)) + (p - left(p)) * (F.get(x, F.least(last, left(p) + 1)) - F.get(x, left(p))))


def softmax(x: Column) -> Column:
    top = F.array_max(x)
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - top))
    return F.transform(x, lambda v: F.exp(v - top) / total)


def cosine_rate(step: Column, warm: int, total: int, top: float) -> Column:
    """A learning rate that rises in a line for ``warm`` steps and falls along half a cosine until ``total``."""
    share = (step - warm) / F.lit(float(max(1, total - warm)))
    return F.when(step < warm, F.lit(top) * step / F.lit(float(warm))).otherwise(F.lit(0.5 * top) * (1 + F.cos(F.lit(np.pi) * F.least(F.lit(1.0), share))))


def padded(x: Column, size: Column, fill: Column) -> Column:
    return F.slice(F.concat(x, F.array_repeat(fill, size)), F.lit(1), size)


def inverted(m: Column) -> Column:
    return F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(e["value"], e["key"])))


def merged_by_most(a: Column, b: Column) -> Column:
    """All keys of two maps with the larger value."""
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.greatest(F.try_element_at(a, k), F.try_element_at(b, k))))


def common_prefix(a: Column, b: Column) -> Column:
    """How many elements two arrays begin with in common."""
    same = F.transform(F.sequence(F.lit(0), F.least(F.size(a), F.size(b))), lambda i: F.slice(a, F.lit(1), i) == F.slice(b, F.lit(1), i))
    return F.array_position(F.concat(same, F.array(F.lit(False))), False).cast("int") - 2


# ---- bytes --------------------------------------------------------------------------------------


def pcm16(x: Column) -> Column:
    """Samples in -1..1 as signed 16-bit little-endian bytes."""
    def two(v):
        whole = F.lpad(F.hex(F.pmod((F.least(F.lit(1.0), F.greatest(F.lit(-1.0), v)) * 32767).cast("int"), F.lit(65536))), 4, "0")
        return F.concat(F.substring(whole, 3, 2), F.substring(whole, 1, 2))

    return F.unhex(F.array_join(F.transform(x, two), ""))


def _little(n: Column, size: int) -> Column:
    whole = F.lpad(F.hex(n), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(whole, 2 * k + 1, 2) for k in reversed(range(size))]))


def with_header(pcm: Column, rate: int) -> Column:
    """A mono 16-bit WAV file: 44 bytes before the samples."""
    n = F.octet_length(pcm)
    number = lambda k, size: _little(F.lit(k), size)
    text = lambda s: F.lit(s.encode())
    return F.concat(text("RIFF"), _little(n + 36, 4), text("WAVEfmt "), number(16, 4), number(1, 2), number(1, 2), number(rate, 4), number(2 * rate, 4), number(2, 2), number(16, 2), text("data"), _little(n, 4), pcm)


def repaired(content: Column, rate: int) -> Column:
    """Files without a header get one."""
    return F.when(F.substring(content, 1, 4) == F.lit(b"RIFF"), content).otherwise(with_header(content, rate))


def pcm_slice(pcm: Column, start: Column, seconds: Column, rate: int) -> Column:
    """The bytes from a second on, for so many seconds."""
    return F.substring(pcm, (start * rate).cast("int") * 2 + 1, (seconds * rate).cast("int") * 2)


def parse_wav(content: bytes | None) -> dict | None:
    """rate and samples of a RIFF file, chunk by chunk: 16-bit or 32-bit float mono; None for anything else."""
    if not content or content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        return None
    at, kind, bits, rate, data = 12, 0, 0, 0, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack("<I", content[at + 4 : at + 8])[0]
        body = content[at + 8 : at + 8 + size]
        if name == b"fmt ":
            kind, _, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
        elif name == b"data":
            data = body
        at += 8 + size + size % 2
    if data is None or (kind, bits) not in ((1, 16), (3, 32)):
        return None
    values = np.frombuffer(data[: len(data) // (bits // 8) * (bits // 8)], "<i2" if kind == 1 else "<f4")
    return {"rate": rate, "samples": (values / 32767 if kind == 1 else values.astype(float)).tolist()}


def wav_samples(content: Column) -> Column:
    """struct<rate, samples> of WAV files."""

    @F.arrow_udf("struct<rate:int,samples:array<double>>")
    def run(content: pa.Array) -> pa.Array:
        return pa.array([parse_wav(x) for x in content.to_pylist()], pa.struct([("rate", pa.int32()), ("samples", pa.list_(pa.float64()))]))

    return run(content)


def floats32(blob: Column, size: int | None = None) -> Column:
    """Little-endian 32-bit floats; null where the size does not fit."""

    @F.arrow_udf("array<float>")
    def run(blob: pa.Array) -> pa.Array:
        fits = lambda x: x is not None and len(x) % 4 == 0 and (size is None or len(x) == 4 * size)
        return pa.array([np.frombuffer(x, "<f4").tolist() if fits(x) else None for x in blob.to_pylist()], pa.list_(pa.float32()))

    return run(blob)


def as_floats32(x: Column) -> Column:
    @F.arrow_udf("binary")
    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if v is None else np.array(v, "<f4").tobytes() for v in x.to_pylist()], pa.binary())

    return run(x)
