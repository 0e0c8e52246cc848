"""Byte-level BPE by a sentencepiece model that is serialised here from a vocabulary of ranks."""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from itertools import chain

import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from fluvia.llm.common import map_slices, table

#: Pre-tokens whose ids are kept; beyond it the memo starts anew, so a worker's memory is bounded.
MEMO = 500_000
#: Bytes stand for characters from here on: one private character a byte, none of which normalisation would touch.
FIRST = 0xE000


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol-buffers message: bytes, a whole number or a 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def mapped(raw: bytes) -> str:
    return raw.decode("latin-1").translate(_TO_CHARS)


_TO_CHARS = {b: FIRST + b for b in range(256)}


def model(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece model: the vocabulary's byte strings as pieces scored by negative rank, so that the best
    merge is the one of the lowest rank; identity normalisation, no dummy prefix, white space as it is."""
    pieces = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))]
    pieces += [_field(1, _field(1, mapped(raw).encode()) + _field(2, float(-rank)) + _field(3, 1)) for raw, rank in sorted(ranks.items(), key=lambda x: x[1])]
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(24, 0) + _field(35, 0) + _field(40, 0) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class ByteBpe:
    """Encodes and decodes as the ranks say. Texts are split by `pattern`; each match is encoded by itself."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find = regex.compile(pattern).findall
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model(self.ranks))
        order = sorted(self.ranks.items(), key=lambda x: x[1])
        self.rank_of = [-1, *(rank for _, rank in order)]  # of a piece's number
        self.raw = {rank: raw for raw, rank in order}
        self.digits = {rank: str(rank) for rank in self.raw}
        self.memo: dict[str, tuple[int, ...]] = {}

    def _learn(self, fresh: list[str]) -> None:
        if len(self.memo) + len(fresh) > MEMO and len(fresh) < MEMO:
            self.memo.clear()
        raws = [x.encode("utf-8", "surrogatepass") for x in fresh]
        hard = []
        for x, raw in zip(fresh, raws, strict=True):
            whole = self.ranks.get(raw)  # a match that is in the vocabulary is one token
            if whole is None:
                hard.append((x, mapped(raw)))
            else:
                self.memo[x] = (whole,)
        if hard:
            for (x, _), ids in zip(hard, self.sp.encode([m for _, m in hard], num_threads=1), strict=True):
                self.memo[x] = tuple(self.rank_of[k] for k in ids)

    def encode(self, text: str) -> list[int]:
        parts = self.find(text)
        while True:
            try:
                return list(chain.from_iterable(map(self.memo.__getitem__, parts)))
            except KeyError:  # some are new, or the memo started anew
                self._learn([x for x in dict.fromkeys(parts) if x not in self.memo])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBpe:
    """One for each Python worker; the vocabulary file is on every machine."""
    return ByteBpe(path, pattern)


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row. A null or empty text has no ids; repeated rows are kept."""

    def work(c: dict[str, list]) -> dict[str, list]:
        bpe = codec(path, pattern)
        return {id_col: c[id_col], "ids": [bpe.encode(x or "") for x in c[text_col]]}

    return map_slices(docs, [id_col, text_col], f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<int>", work)


def decode_ids(rows: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded binary) of every row by the inverse mapping. Null ids are taken as none."""

    def work(c: dict[str, list]) -> dict[str, list]:
        bpe = codec(path, pattern)
        return {id_col: c[id_col], "decoded": [bpe.decode(x or []) for x in c[ids_col]]}

    return map_slices(rows, [id_col, ids_col], f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, decoded binary", work)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encoding, decoding and their digests in one pass, so that the ids of whole texts never travel."""

    def work(c: dict[str, list]) -> dict[str, list]:
        bpe = codec(path, pattern)
        out: dict[str, list] = {"doc_id": c["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for text in c["text"]:
            ids = bpe.encode(text or "")
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(",".join(map(bpe.digits.__getitem__, ids)).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(bpe.decode(ids)).hexdigest())
        return out

    return map_slices(docs, ["doc_id", "text"], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", work)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of every whole text of documents."""
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
