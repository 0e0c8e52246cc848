"""Avro object container files without Spark's Avro package.

Files are read through Spark's binary source, so from any store that Spark reads, one file a task at most; written files
go to a folder that all executors mount. Records of null, boolean, int, long, float, double, bytes, string, enums, fixed,
arrays, maps, nested records and unions of one type with null; blocks plain or deflated.
"""

from __future__ import annotations

import io
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import islice
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAGIC = b"Obj\x01"
PLAIN = {"boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "bytes": T.BinaryType(), "string": T.StringType()}
#: Bytes of a file's start that hold its schema at most, rows of a block that is written, and rows handed on at a time.
HEAD, BLOCK_ROWS, CHUNK = 1 << 20, 4096, 4096


# ---- values ----------------------------------------------------------------------------------------------------------


def read_long(f: io.BytesIO) -> int:
    shift = n = 0
    while True:
        b = f.read(1)[0]
        n |= (b & 127) << shift
        if b < 128:
            return (n >> 1) ^ -(n & 1)
        shift += 7


def write_long(out: bytearray, n: int) -> None:
    n = (n << 1) ^ (n >> 63)
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def _blocks(f: io.BytesIO) -> Iterator[int]:
    """The counts of an array's or a map's blocks."""
    while count := read_long(f):
        if count < 0:
            read_long(f)  # the block's size, for those who skip it
        yield abs(count)


def _kind(schema: Any, named: dict[str, Any]) -> tuple[str, Any]:
    """A schema's kind and the schema with names resolved."""
    if isinstance(schema, list):
        return "union", schema
    if isinstance(schema, str):
        return (schema, schema) if schema in PLAIN or schema == "null" else _kind(named[schema], named)
    kind = schema["type"]
    if not isinstance(kind, str):
        return _kind(kind, named)
    if "name" in schema and kind in ("record", "enum", "fixed"):
        named.setdefault(schema["name"], schema)
    return kind, schema


def decode(f: io.BytesIO, schema: Any, named: dict[str, Any]) -> Any:
    kind, schema = _kind(schema, named)
    match kind:
        case "null":
            return None
        case "boolean":
            return f.read(1) == b"\x01"
        case "int" | "long":
            return read_long(f)
        case "float":
            return struct.unpack("<f", f.read(4))[0]
        case "double":
            return struct.unpack("<d", f.read(8))[0]
        case "bytes":
            return f.read(read_long(f))
        case "string":
            return f.read(read_long(f)).decode()
        case "union":
            return decode(f, schema[read_long(f)], named)
        case "enum":
            return schema["symbols"][read_long(f)]
        case "fixed":
            return f.read(schema["size"])
        case "array":
            return [decode(f, schema["items"], named) for n in _blocks(f) for _ in range(n)]
        case "map":
            return {decode(f, "string", named): decode(f, schema["values"], named) for n in _blocks(f) for _ in range(n)}
        case "record":
            return {x["name"]: decode(f, x["type"], named) for x in schema["fields"]}
    raise ValueError(f"no such Avro type: {kind}")


def encode(out: bytearray, schema: Any, v: Any) -> None:
    """A value by the schemas that `avro_schema` makes: unions are those of null and one type."""
    if isinstance(schema, list):
        write_long(out, int(v is not None))
        if v is not None:
            encode(out, schema[1], v)
        return
    kind = schema if isinstance(schema, str) else schema["type"]
    match kind:
        case "boolean":
            out.append(bool(v))
        case "int" | "long":
            write_long(out, int(v))
        case "float":
            out += struct.pack("<f", v)
        case "double":
            out += struct.pack("<d", v)
        case "bytes" | "string":
            raw = v.encode() if isinstance(v, str) else bytes(v)
            write_long(out, len(raw))
            out += raw
        case "array":
            if len(v):
                write_long(out, len(v))
                for x in v:
                    encode(out, schema["items"], x)
            out.append(0)
        case "map":
            items = dict(v)
            if items:
                write_long(out, len(items))
                for k, x in items.items():
                    encode(out, "string", k)
                    encode(out, schema["values"], x)
            out.append(0)
        case "record":
            for x in schema["fields"]:
                encode(out, x["type"], v[x["name"]])


# ---- schemas ---------------------------------------------------------------------------------------------------------


def spark_type(schema: Any, named: dict[str, Any]) -> tuple[T.DataType, bool]:
    """Spark's type, and whether it may be null."""
    kind, schema = _kind(schema, named)
    if kind == "union":
        rest = [s for s in schema if s != "null"]
        if len(rest) != 1:
            raise ValueError("only unions of one type with null can be columns")
        return spark_type(rest[0], named)[0], len(rest) < len(schema)
    if kind == "array":
        inner, may = spark_type(schema["items"], named)
        return T.ArrayType(inner, may), False
    if kind == "map":
        inner, may = spark_type(schema["values"], named)
        return T.MapType(T.StringType(), inner, may), False
    if kind == "record":
        return T.StructType([T.StructField(x["name"], *spark_type(x["type"], named)) for x in schema["fields"]]), False
    return {"enum": T.StringType(), "fixed": T.BinaryType()}.get(kind) or PLAIN[kind], False


def avro_schema(kind: T.DataType, name: str = "row") -> Any:
    """An Avro schema for a Spark type; every field may be null."""
    if isinstance(kind, T.StructType):
        return {"type": "record", "name": name, "fields": [{"name": f.name, "type": ["null", avro_schema(f.dataType, f"{name}_{f.name}")]} for f in kind]}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": ["null", avro_schema(kind.elementType, name + "_item")]}
    if isinstance(kind, T.MapType):
        return {"type": "map", "values": ["null", avro_schema(kind.valueType, name + "_value")]}
    if isinstance(kind, T.ByteType | T.ShortType):
        return "int"
    for avro, spark in PLAIN.items():
        if kind == spark:
            return avro
    raise ValueError(f"no Avro type for {kind.simpleString()}; cast the column first")


# ---- files -----------------------------------------------------------------------------------------------------------


def read_header(f: io.BytesIO) -> tuple[Any, str, bytes]:
    """The schema, the codec and the marker between blocks."""
    if f.read(4) != MAGIC:
        raise ValueError("not an Avro object container file")
    meta = decode(f, {"type": "map", "values": "bytes"}, {})
    return json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode(), f.read(16)


def records(raw: bytes) -> Iterator[dict[str, Any]]:
    f = io.BytesIO(raw)
    schema, codec, sync = read_header(f)
    named: dict[str, Any] = {}
    while f.tell() < len(raw):
        count, size = read_long(f), read_long(f)
        block = f.read(size)
        if f.read(16) != sync:
            raise ValueError("a block's marker is wrong")
        if codec == "deflate":
            block = zlib.decompress(block, -15)
        elif codec != "null":
            raise ValueError(f"no such codec: {codec}")
        inner = io.BytesIO(block)
        for _ in range(count):
            yield decode(inner, schema, named)


def container(rows: Iterator[dict[str, Any]], schema: Any, sync: bytes) -> Iterator[bytes]:
    head = bytearray(MAGIC)
    encode(head, {"type": "map", "values": "bytes"}, {"avro.schema": json.dumps(schema).encode(), "avro.codec": b"deflate"})
    yield bytes(head) + sync
    while some := list(islice(rows, BLOCK_ROWS)):
        block = bytearray()
        for r in some:
            encode(block, schema, r)
        packer = zlib.compressobj(wbits=-15)
        packed = packer.compress(bytes(block)) + packer.flush()
        out = bytearray()
        write_long(out, len(some))
        write_long(out, len(packed))
        yield bytes(out) + packed + sync


def read(spark: SparkSession, path: str) -> DataFrame:
    """All files of a path; the schema is that of the first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    head = files.orderBy("path").select(F.substring("content", 1, HEAD).alias("c")).first()
    if head is None:
        raise FileNotFoundError(path)
    kind, _ = spark_type(read_header(io.BytesIO(bytes(head["c"])))[0], {})
    names = kind.names

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for raw in part["content"]:
                rows = records(bytes(raw))
                while some := list(islice(rows, CHUNK)):
                    yield pd.DataFrame({n: pd.Series([r[n] for r in some], dtype=object) for n in names})

    return files.select("content").mapInPandas(run, kind)


def write(df: DataFrame, folder: str, one: bool = False) -> None:
    """A file for each partition in a new folder on a mounted file system."""
    folder = re.sub("^file:/+", "/", folder)
    if "://" in folder:
        raise ValueError("without Spark's Avro package files can only be written to a mounted file system")
    os.makedirs(folder)
    schema = avro_schema(df.schema)
    rows = df.coalesce(1) if one else df

    def save(index: int, part: Iterator[Any]) -> Iterator[int]:
        # written under another name first, so that an attempt that fails leaves no half file behind
        held = f"{folder}/.part-{index:05d}.{os.getpid()}"
        with open(held, "wb") as f:
            for piece in container((r.asDict(recursive=True) for r in part), schema, struct.pack("<QQ", 0x9E3779B97F4A7C15, index)):
                f.write(piece)
        os.replace(held, f"{folder}/part-{index:05d}.avro")
        yield index

    rows.rdd.mapPartitionsWithIndex(save).count()
