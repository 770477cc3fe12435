"""Scalar helpers as Column expressions, and the same for plain Python values where a driver needs them."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decimal size units.
UNITS = {"kb": 1000, "mb": 1000**2, "gb": 1000**3, "tb": 1000**4}

# Element type codes of array leaves.
TORCH_DTYPES = {
    0: "float32", 1: "float", 2: "float64", 3: "double", 4: "complex64", 5: "cfloat", 6: "complex128", 7: "cdouble", 8: "float16", 9: "half",
    10: "bfloat16", 11: "uint8", 12: "int8", 13: "int16", 14: "short", 15: "int32", 16: "int", 17: "int64", 18: "long", 19: "bool",
}
NUMPY_DTYPES = {
    0: "int8", 1: "int16", 2: "int32", 3: "int64", 4: "uint8", 5: "uint16", 6: "uint32", 7: "uint64", 8: "float16", 9: "float32",
    10: "float64", 11: "complex64", 12: "complex128", 13: "bool", 14: "object", 15: "bytes", 16: "str", 17: "void",
}


def bytes_of(size: str) -> int:
    """`64MB` as a number; decimal units kb to tb in any case, with a fraction if need be. A bare `b` is no unit."""
    found = re.fullmatch(r"\s*([0-9]*\.?[0-9]+)\s*(kb|mb|gb|tb)\s*", size, re.I)
    if not found:
        raise ValueError(f"not a size with a unit of {', '.join(UNITS)}: {size!r}")
    return int(float(found[1]) * UNITS[found[2].lower()])


def bytes_column(size: Column) -> Column:
    """bytes_of() for a column; null where it is no size."""
    shape = r"(?i)^\s*([0-9]*\.?[0-9]+)\s*(kb|mb|gb|tb)\s*$"
    unit = F.lower(F.regexp_extract(size, shape, 2))
    factor = F.lit(None).cast("double")
    for name, n in UNITS.items():
        factor = F.when(unit == name, float(n)).otherwise(factor)
    return F.when(size.rlike(shape), F.floor(F.regexp_extract(size, shape, 1).cast("double") * factor)).cast("long")


def human_bytes(n: Column) -> Column:
    """A count of bytes by thousands, one digit after the point."""
    out = F.format_string("%3.1f PB", n / 1e15)
    for unit, size in (("TB", 1e12), ("GB", 1e9), ("MB", 1e6), ("KB", 1e3), ("B", 1.0)):
        out = F.when(n < size * 1000, F.format_string(f"%3.1f {unit}", n / size)).otherwise(out)
    return out


CHUNK_NAME = r"^chunk-(\d+)-(\d+)(?:\.[A-Za-z0-9_]+)*\.bin$"


def chunk_rank(name: Column) -> Column:
    return F.when(name.rlike(CHUNK_NAME), F.regexp_extract(name, CHUNK_NAME, 1).cast("long"))


def chunk_number(name: Column) -> Column:
    return F.when(name.rlike(CHUNK_NAME), F.regexp_extract(name, CHUNK_NAME, 2).cast("long"))


def without_uuid(name: Column) -> Column:
    """A checkpoint's name without its uuid: `checkpoint-0-<uuid>.json` as `checkpoint-0.json`; other names stay."""
    return F.regexp_replace(name, r"^(checkpoint-.*?)-[0-9a-fA-F-]{32,36}\.json$", "$1.json")


def bucket_of(url: Column) -> Column:
    """What stands between `://` and the first `/`."""
    return F.regexp_extract(url, r"^[a-z0-9]+://([^/]*)", 1)


def path_in_bucket(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z0-9]+://[^/]*/?(.*)$", 1)


def with_time(path: str, now: datetime.datetime) -> str:
    """A path with `{%Y-...}` filled in by strftime."""
    return re.sub(r"\{(%[^}]*)\}", lambda m: now.strftime(m[1]), path)
