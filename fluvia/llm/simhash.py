"""SimHash near-duplicates: meet-in-the-middle ball hashing of 64-bit fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.llm.common import checkpointed, connected_components, give_back, map_slices, table, written
from fluvia.llm.neighbours import groups_of

SEED, SHINGLE, RADIUS = 42, 3, 3
#: Variants of a part, about: those whose hashes fall in it meet in one task (10 bytes each). A fingerprint makes 561 on average.
PART_VARIANTS, AVERAGE = 1_000_000, 561
#: Fingerprints whose variants are made together at most.
MADE = 4096


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64 majority bits over the XXH64 of a text's word shingles, as a signed number. A text without words gives 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII white space parts
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    n, digest, totals = len(starts), xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 15)], ends[at : at + (1 << 15)], strict=True)])
        totals += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * totals > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp bigint) of every row; a null text counts as empty."""

    def work(c: dict[str, list]) -> dict[str, list]:
        return {id_col: c[id_col], "fp": [fingerprint(t or "") for t in c[text_col]]}

    return map_slices(docs, [id_col, text_col], f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp bigint", work)


def balls() -> tuple[np.ndarray, np.ndarray]:
    """Masks of the variants of fingerprints of odd and of even parity; the first 65 are those within one bit."""
    one = [1 << k for k in range(64)]
    two = [1 << i | 1 << j for base in (0, 32) for i in range(base, base + 32) for j in range(i + 1, base + 32)]
    return np.array([0, *one], np.uint64), np.array([0, *one, *two], np.uint64)


def variants(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All variants of fingerprints, and the place in fps of each one's owner, doubled, plus 1 for two-bit variants."""
    odd_masks, even_masks = balls()
    even = np.bitwise_count(fps) % 2 == 0
    made, owners = [], []
    for masks, at in ((odd_masks, np.flatnonzero(~even)), (even_masks, np.flatnonzero(even))):
        made.append((fps[at][:, None] ^ masks[None]).ravel())
        owners.append((at[:, None] * 2 + (np.arange(len(masks)) > 64)[None]).ravel().astype(np.uint16))
    return np.concatenate(made), np.concatenate(owners)


def part_of(variant: np.ndarray, parts: int) -> np.ndarray:
    """A part for each variant, by a multiplicative hash of all its bits."""
    h = variant * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return ((h >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)


def collisions(variant: np.ndarray, fp: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs of the owners of equal variants: the smallest owner within one bit, with each of the others."""
    order = np.argsort(variant)
    variant = variant[order]
    same = variant[1:] == variant[:-1]
    shared = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
    if not len(shared):
        return fp[:0], fp[:0]
    group, fp, two = variant[shared], fp[order[shared]], two[order[shared]]
    order = np.lexsort((fp, two, group))
    group, fp, two = group[order], fp[order], two[order]
    start = np.concatenate([[True], group[1:] != group[:-1]])
    first = np.flatnonzero(start)[np.cumsum(start) - 1]
    a, b = fp[first], fp
    keep = ~two[first] & (a != b) & (np.bitwise_count(a ^ b) <= RADIUS)
    pairs = np.unique(np.stack([a[keep], b[keep]], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def close_pairs(fps: DataFrame) -> DataFrame:
    """(a, b) of fingerprints within RADIUS (3) bits, enough of them that all within it are connected; fps: distinct column fp.

    Every fingerprint emits all variants within half the radius. Half of three is one bit on one side and two on the other:
    two fingerprints at distance 3 differ in parity, so only the even one emits two-bit variants, and of any three bits two
    lie in the same 32-bit half, so only pairs within a half. Those that share a variant within one bit of each are at most
    2 apart, a two-bit variant's owner at most 3 from them: a star to the smallest of the former joins them all, without
    emitting all pairs. At most 1,057 fingerprints can share a variant.

    Variants are shuffled as columns, a row for each part and each few thousand fingerprints, so one takes ten bytes: itself and
    its owner's number among the row's fingerprints. Their number grows as that of the fingerprints, and parts with it.
    """
    spark = fps.sparkSession
    least, count = int(spark.conf.get("spark.sql.shuffle.partitions")), fps.count()
    parts = max(least, count * AVERAGE // PART_VARIANTS + 1)
    batch = min(MADE, max(256, 2 * parts))  # so that a row holds some hundred variants

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(held), batch):
                own = held[at : at + batch]
                made, owner = variants(own)
                part = part_of(made, parts).astype(np.int32)
                order = np.argsort(part, kind="stable")
                part, made, owner = part[order], made[order], owner[order]
                cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist()
                rows: dict[str, list] = {"part": part[cuts].tolist(), "variants": [], "owners": [], "own": []}
                for s, e in zip(cuts, [*cuts[1:], len(part)], strict=True):
                    used, place = np.unique(owner[s:e] >> 1, return_inverse=True)
                    rows["variants"].append(made[s:e].tobytes())
                    rows["owners"].append((place.astype(np.uint16) * 2 + (owner[s:e] & 1)).astype(np.uint16).tobytes())
                    rows["own"].append(own[used].tobytes())
                for k in range(0, len(cuts), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(rows["part"][k : k + 64], pa.int32()), *(pa.array(rows[n][k : k + 64], pa.binary()) for n in ("variants", "owners", "own"))], ["part", "variants", "owners", "own"])
        give_back()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups_of(batches, ["part"]):
            variant, fp, two = [], [], []
            for v, o, own in zip(*(g.column(n).to_pylist() for n in ("variants", "owners", "own")), strict=True):
                owner = np.frombuffer(o, np.uint16)
                variant.append(np.frombuffer(v, np.uint64))
                fp.append(np.frombuffer(own, np.uint64)[owner >> 1])
                two.append(owner & 1 == 1)
            a, b = collisions(np.concatenate(variant), np.concatenate(fp), np.concatenate(two))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
        give_back()

    spread = fps.select("fp").repartition(max(least, count // MADE + 1))  # a table of fingerprints is small, its variants aren't
    rows = spread.mapInArrow(emitted, "part int, variants binary, owners binary, own binary")
    return written(rows.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(met, "a bigint, b bigint")).distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) of every row: component_id is the smallest id reachable by links.

    Equal fingerprints link, those of texts without words (0) too. Rows with a null id link like any other, but give no
    component its id. Repeated rows are kept. An empty table gives an empty result.
    """
    fps = checkpointed(fingerprints(docs, id_col, text_col))
    classes = checkpointed(fps.groupBy("fp").agg(F.min(id_col).alias("low")))
    comps = connected_components(close_pairs(classes.select("fp")))
    named = classes.join(comps, classes["fp"] == comps["node"], "left").select("fp", "low", F.col("component"))
    linked, alone = checkpointed(named.where("component IS NOT NULL")), named.where("component IS NULL")
    # a table of its own on each side, so that a large group's rows can be dealt to several tasks
    lowest = checkpointed(linked.groupBy("component").agg(F.min("low").alias("component_id")))
    of = checkpointed(linked.join(lowest, "component").select("fp", "component_id").unionByName(alone.select("fp", F.col("low").alias("component_id"))))
    return fps.join(of, "fp").select(id_col, "fp", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every whole text of documents."""
    out = simhash_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one document of each group, that of the smallest doc_id (nulls last); of rows that share that id, the one whose
    text's hash is smallest, and of its repetitions one. Columns stay.

    A row's number stands for it in the groups, so rows without an id, or with one id and different texts, are documents of their own.
    """
    names = docs.columns
    of = F.xxhash64(F.col("doc_id").isNull(), "doc_id")
    rows = docs.withColumns({"__hash": F.xxhash64("text"), "__second": F.xxhash64(F.lit(1), "text"), "__of": of})
    keyed = rows.select(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("__hash").alias("hash"), F.col("__second").alias("second")).alias("key"), "text")
    groups = simhash_groups(keyed, "key", "text").where("key = component_id").select("key").distinct()
    kept = groups.select(F.col("key.hash").alias("__hash"), F.col("key.second").alias("__second"), F.xxhash64("key.none", "key.id").alias("__of"))
    # repetitions are dropped by the columns that the join deals rows by, so texts are shuffled once
    return rows.join(kept, ["__hash", "__second", "__of"], "left_semi").dropDuplicates(["doc_id", "__hash", "__second", "__of"]).select(*names)
