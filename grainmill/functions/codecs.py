"""Values as bytes and back: leaf codecs by their keys, compression and encryption."""

from __future__ import annotations

import hashlib
import struct

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from grainmill.functions.helpers import NUMPY_DTYPES

CODES = {name: code for code, name in NUMPY_DTYPES.items()}


def _array(x: np.ndarray) -> bytes:
    return struct.pack(f"<{2 + x.ndim}I", CODES[x.dtype.name], x.ndim, *x.shape) + np.ascontiguousarray(x).tobytes()


def _to_array(data: bytes) -> np.ndarray:
    code, ndim = struct.unpack_from("<2I", data)
    shape = struct.unpack_from(f"<{ndim}I", data, 8)
    return np.frombuffer(data, dtype=NUMPY_DTYPES[code], offset=8 + 4 * ndim).reshape(shape)


#: key: (encode, decode). Pickled values are read back as bytes; nothing is unpickled.
LEAVES = {
    "str": (lambda x: x.encode(), lambda b: bytes(b).decode()),
    "bool": (lambda x: b"\1" if x else b"\0", lambda b: bytes(b) == b"\1"),
    "int": (lambda x: struct.pack("<q", x), lambda b: struct.unpack("<q", b)[0]),
    "float": (lambda x: struct.pack("<d", x), lambda b: struct.unpack("<d", b)[0]),
    "bytes": (bytes, bytes),
    "numpy": (_array, _to_array),
    "pickle": (bytes, bytes),
}


def codec(key: str):
    """The codec of a key; `no_header_numpy:<code>` is a one-dimensional array of that element type."""
    if key.startswith("no_header_numpy:"):
        kind = NUMPY_DTYPES[int(key.partition(":")[2])]
        return (lambda x: np.ascontiguousarray(x, dtype=kind).tobytes()), (lambda b: np.frombuffer(b, dtype=kind))
    return LEAVES[key.partition(":")[0] if key.startswith(("file:", "video:")) and key not in LEAVES else key] if not key.startswith(("file:", "video:", "jpeg", "pil", "tiff")) else LEAVES["bytes"]


def key_of(value) -> str:
    """The key that a value is written by: the first that fits."""
    if isinstance(value, str):
        return "str"
    if isinstance(value, (bool, np.bool_)):
        return "bool"
    if isinstance(value, (int, np.integer)):
        return "int"
    if isinstance(value, float):
        return "float"
    if isinstance(value, (bytes, bytearray)):
        return "bytes"
    if isinstance(value, np.ndarray) and value.ndim == 1 and value.dtype.name in CODES:
        return f"no_header_numpy:{CODES[value.dtype.name]}"
    if isinstance(value, np.ndarray) and value.ndim > 1 and value.dtype.name in CODES:
        return "numpy"
    raise TypeError(f"no codec for {type(value).__name__}")


def compressor(name: str | None):
    """compress and decompress for a name: None, `zstd` or `zstd:1` to `zstd:22`."""
    if name is None:
        return bytes, bytes
    kind, _, level = name.partition(":")
    if kind != "zstd" or not 1 <= int(level or 4) <= 22:
        raise ValueError(f"unknown compression {name!r}")
    import zstandard

    return zstandard.ZstdCompressor(level=int(level or 4)).compress, lambda b: zstandard.ZstdDecompressor().decompressobj().decompress(b)


def key_from(password: str, salt: bytes, rounds: int = 480_000) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, rounds, 32)


def encrypted(data: Column, key: bytes) -> Column:
    """AES-GCM with a fresh nonce for each value."""
    return F.aes_encrypt(data, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"))


def decrypted(data: Column, key: bytes) -> Column:
    return F.aes_decrypt(data, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"))


def flattened(value, path: str = "") -> list[tuple[str, object]]:
    """A nested value's leaves with their paths: dict keys, `_0`, `_1` for tuples and lists."""
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in flattened(v, f"{path}.{k}" if path else str(k))]
    if isinstance(value, tuple) and hasattr(value, "_fields"):
        return [x for k, v in zip(value._fields, value, strict=True) for x in flattened(v, f"{path}.{k}" if path else k)]
    if isinstance(value, (tuple, list)):
        return [x for i, v in enumerate(value) for x in flattened(v, f"{path}._{i}" if path else f"_{i}")]
    return [(path or "_0", value)]
