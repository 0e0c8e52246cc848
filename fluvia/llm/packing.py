"""Packing by lexical retrieval: a sharded BM25 index returns unused neighbours of a seed, which fill its window."""

from __future__ import annotations

import functools
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.llm.common import SLICE_ROWS, give_back, small_batches, table
from fluvia.llm.neighbours import groups_of

WINDOW, END_ID = 4096, 2
#: Bytes of text of a shard, about; documents are dealt out to shards by a hash.
SHARD_BYTES = 4_000_000
#: Words, and runs of letters in them, whose ids a worker keeps at most (about 150 bytes each); longer words aren't kept by run.
MEMO, MEMO_RUNS, LONG_WORD = 900_000, 900_000, 64
#: BM25's usual constants.
K1, B = 1.2, 0.75
#: Words that stand in more than one of so many documents of a shard have a row of weights for all of its documents.
FREQUENT = 8
#: White space to Python's split, but not to the tokenizer.
ODD = "\x1c\x1d\x1e\x1f"
#: Marks that the tokenizer parts from letters before them.
MARKS = ".,!?;:#$%&*|()[]"


class WordIds:
    """Ids of texts by a tokenizer that never looks across white space, so each word's are found once.

    The tokenizer also parts a run of letters from the marks behind it, and small letters stand for capitals. So words that
    differ in those alone share what is held of their letters.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        if max(vocabulary.values()) >= 1 << 16:
            raise ValueError("ids beyond 16 bits")
        self.ends = np.zeros(1 << 16, bool)  # ids that end a word
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.memo: dict[str, bytes] = {}
        self.letters: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}

    def _ids(self, text: str) -> bytes:
        return array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _runs(self, runs: list[str]) -> list[bytes]:
        """Ids of runs of letters, encoded together and parted where a word ends."""
        out: list[bytes] = []
        for at in range(0, len(runs), 2000):
            some = runs[at : at + 2000]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u2")
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 2
            if len(stops) == len(some):
                raw, start = ids.tobytes(), 0
                for stop in stops.tolist():
                    out.append(raw[start:stop])
                    start = stop
            else:
                out += map(self._ids, some)
        return out

    def learn(self, words: list[str]) -> None:
        for held, most in ((self.memo, MEMO), (self.letters, MEMO_RUNS)):
            if len(held) + len(words) > most and len(words) < most:
                held.clear()
        parted, fresh = [], {}
        for w in words:
            run = w.rstrip(MARKS)
            if run.isalpha() and len(w) <= LONG_WORD:
                low = run.lower() if run.isascii() or not ("\u03a3" in run or "\u0130" in run) else run
                parted.append((w, low, w[len(run) :]))
                if low not in self.letters:
                    fresh[low] = None
            else:
                self.memo[w] = self._ids(w)
        if fresh:
            self.letters.update(zip(fresh, self._runs(list(fresh)), strict=True))
        for w, low, mark in parted:
            if mark not in self.marks:
                self.marks[mark] = self._ids(mark)
            self.memo[w] = self.letters[low] + self.marks[mark]

    def encode(self, text: str) -> bytes:
        """Ids as unsigned 16-bit little-endian numbers."""
        words = text.split()
        if any(c in text for c in ODD):
            return self._ids(text)
        while True:
            try:
                return b"".join(map(self.memo.__getitem__, words))
            except KeyError:
                self.learn([w for w in dict.fromkeys(words) if w not in self.memo])


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pack(docs: list[np.ndarray], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of all pieces of a shard; documents are arrays of ids that end in END_ID.

    The longest unused document is the next seed. A window that it doesn't fill is filled with the unused documents that
    BM25 ranks best for all of the seed's words, then with the longest unused. What is cut off at a window's end opens
    the next window, as its seed. Only the last sequence can stay short. Equal scores go by the order of documents.
    """
    n = len(docs)
    lens = np.array([len(d) for d in docs], np.int64)
    # postings: for each word the documents that hold it, and their weights
    key, tf = np.unique(np.repeat(np.arange(n, dtype=np.int64) << 16, lens) + np.concatenate(docs), return_counts=True)
    doc, term = key >> 16, key & 0xFFFF
    keep = term != END_ID
    doc, term, tf = doc[keep], term[keep], tf[keep]
    df = np.bincount(term, minlength=1 << 16)
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lens[doc] / lens.mean()))
    by_doc = np.searchsorted(doc, np.arange(n + 1))
    order = np.argsort(term, kind="stable")
    p_doc, p_weight = doc[order], weight[order]
    ends = np.cumsum(df)
    begins = ends - df
    often = np.flatnonzero(df * FREQUENT > n)
    row = np.full(1 << 16, -1)
    row[often] = np.arange(len(often))
    rows = np.zeros((len(often), n), np.float32)  # at most FREQUENT numbers for each posting
    rows[row[term[row[term] >= 0]], doc[row[term] >= 0]] = weight[row[term] >= 0]

    def neighbours(seed: int) -> np.ndarray:
        words = term[by_doc[seed] : by_doc[seed + 1]]
        words = words[df[words] > 1]
        if not len(words):
            return words
        score = rows[row[words[row[words] >= 0]]].sum(0).astype(np.float64)
        rare = words[row[words] < 0]
        held = df[rare]
        at = np.repeat(begins[rare] - np.cumsum(held) + held, held) + np.arange(held.sum())
        score += np.bincount(p_doc[at], weights=p_weight[at], minlength=n)
        score[used] = 0
        hits = np.flatnonzero(score)
        if len(hits) > 64:  # far more than fill a window, unless they are very short; then the next round asks again
            hits = hits[np.argpartition(-score[hits], 63)[:64]]
        return hits[np.lexsort((hits, -score[hits]))]

    used = np.zeros(n, bool)
    queue = np.lexsort((np.arange(n), -lens)).tolist()
    out, at, seq, space = [], 0, 0, window
    carried: tuple[int, int] | None = None  # a document and its ids placed so far

    def place(d: int, start: int) -> tuple[int, int] | None:
        nonlocal seq, space
        length = min(int(lens[d]) - start, space)
        out.append((d, start, length, seq, window - space))
        space -= length
        if not space:
            seq, space = seq + 1, window
        return (d, start + length) if start + length < lens[d] else None

    while True:
        if carried is None:
            while at < n and used[queue[at]]:
                at += 1
            if at == n:
                return out
            carried = queue[at], 0
            used[queue[at]] = True
        seed = carried[0]
        now = seq
        carried = place(*carried)
        while carried is None and seq == now:
            found = neighbours(seed)
            if not len(found):
                break
            for d in found.tolist():
                used[d] = True
                carried = place(d, 0)
                if seq != now:
                    break


def packed(docs: DataFrame, path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all rows: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Rows are dealt to shards by a hash of the row and of its part of the input, so rows that repeat don't all meet in one shard.
    A null or empty text is one id, the one that ends every document. Repeated rows are documents of their own. Sequences are
    full but for the last of each shard, which is padded to the next power of two.
    """
    spark = docs.sparkSession
    small_batches(spark)
    size = docs.agg(F.sum(F.octet_length(text_col) + 32)).first()[0] or 0
    shards = max(1, -(-int(size) // SHARD_BYTES))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.spark_partition_id(), id_col, text_col), F.lit(shards)).alias("shard"))

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tail = word_ids(path), np.array([END_ID], "<u2").tobytes()
        for b in batches:
            for at in range(0, b.num_rows, SLICE_ROWS):
                part = b.slice(at, SLICE_ROWS)
                ids = [words.encode(t or "") + tail for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(ids, pa.binary())], ["id", "shard", "ids"])
        give_back()

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups_of(batches, ["shard"]):
            ids = [np.frombuffer(x, "<u2") for x in g.column("ids").to_pylist()]
            pieces = pack(ids, window)
            own = g.column("id").combine_chunks().take(pa.array([p[0] for p in pieces], pa.int64()))
            crc = [zlib.crc32(ids[d][s : s + n].astype("<u4").tobytes()) for d, s, n, _, _ in pieces]
            cols = list(zip(*pieces, strict=True))
            base = g.column("shard")[0].as_py() << 32
            values = [cols[1], cols[2], crc, [len(ids[d]) for d in cols[0]], [base + s for s in cols[3]], cols[4]]
            yield pa.RecordBatch.from_arrays([own, *(pa.array(v, pa.int64()) for v in values)], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        give_back()

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shards // 4))
    ready = rows.mapInArrow(tokenized, f"id {kind}, shard bigint, ids binary").repartition(parts, "shard").sortWithinPartitions("shard", "id")
    out = ready.mapInArrow(filled, f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
    return out.withColumnRenamed("id", id_col)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of 4096 ids at most."""
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
