"""Readers of file formats that Spark has none for: legacy charsets, safetensors, raw float vectors."""

from __future__ import annotations

import json
import math
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DTYPES = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "U8": "u1"}


def read_charset(spark: SparkSession, path: str, charset: str = "shift_jis") -> DataFrame:
    """path, text of each file, decoded from a legacy charset; a byte sequence outside it is an error."""

    @F.pandas_udf(T.StringType())
    def decode(content: pd.Series) -> pd.Series:
        return content.map(lambda b: bytes(b).decode(charset))

    return spark.read.format("binaryFile").load(path).select("path", decode("content").alias("text"))


def parse_safetensors(content: bytes) -> list[tuple[str, str, list[int], bytes]]:
    """(name, dtype, shape, bytes) of each tensor of a safetensors file, in the order of their bytes.

    The layout: a little-endian 64-bit length, a JSON object of that length that says each tensor's type, shape and place
    (counted from behind the object; "__metadata__" is a note), and the tensors' bytes, which leave no gap. A file that
    departs from it is an error, as is one without tensors.
    """
    view = memoryview(content)
    start = 8 + int.from_bytes(view[:8], "little")
    if len(view) < 8 or start > len(view):
        raise ValueError(f"the header ends at byte {start} of {len(view)}")
    tensors = sorted((spec["data_offsets"], name, spec["dtype"], spec["shape"]) for name, spec in json.loads(bytes(view[8:start])).items() if name != "__metadata__")
    end, found = 0, []
    for (begin, stop), name, dtype, shape in tensors:
        if dtype not in _DTYPES:
            raise ValueError(f"{name} has the unknown type {dtype}")
        if begin != end or stop - begin != math.prod(shape) * np.dtype(_DTYPES[dtype]).itemsize or start + stop > len(view):
            raise ValueError(f"{name} is {shape} of {dtype}, but lies at {begin} to {stop}")
        end = stop
        found.append((name, dtype, list(shape), bytes(view[start + begin : start + stop])))
    if not found:
        raise ValueError("no tensors")
    return found


def write_safetensors(tensors: dict[str, np.ndarray]) -> bytes:
    names = {np.dtype(v): k for k, v in _DTYPES.items()}
    header, body = {}, b""
    for name, x in tensors.items():
        raw = np.ascontiguousarray(x).tobytes()
        header[name] = {"dtype": names[x.dtype], "shape": list(x.shape), "data_offsets": [len(body), len(body) + len(raw)]}
        body += raw
    text = json.dumps(header).encode()
    return struct.pack("<Q", len(text)) + text + body


def explode_safetensors(files: DataFrame, *keys: str) -> DataFrame:
    """files: content, and keys that go along. -> keys, name, dtype, shape, data of each tensor."""

    def run(batches):
        for b in batches:
            rows = [(*k, *t) for *k, content in zip(*(b[c] for c in keys), b["content"], strict=True) for t in parse_safetensors(bytes(content))]
            yield pd.DataFrame(rows, columns=[*keys, "name", "dtype", "shape", "data"])

    kinds = "".join(f"{c} {files.schema[c].dataType.simpleString()}, " for c in keys)
    return files.select(*keys, "content").mapInPandas(run, kinds + "name string, dtype string, shape array<long>, data binary")


def pack_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding -> vec_id, raw: little-endian 32-bit floats."""

    @F.pandas_udf(T.BinaryType())
    def pack(x: pd.Series) -> pd.Series:
        return x.map(lambda v: np.asarray(v, "<f4").tobytes())

    return vectors.select("vec_id", pack("embedding").alias("raw"))


def unpack_vectors(packed: DataFrame, width: int) -> DataFrame:
    """The reverse; a row of another width is an error."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def unpack(x: pd.Series) -> pd.Series:
        def one(raw: bytes) -> np.ndarray:
            v = np.frombuffer(raw, "<f4")
            if len(v) != width:
                raise ValueError(f"a vector of {len(v)} numbers, not {width}")
            return v

        return x.map(one)

    return packed.select("vec_id", unpack("raw").alias("embedding"))
