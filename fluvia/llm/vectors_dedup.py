"""Near-duplicate vectors by cosine: p-stable hashing of normalised vectors in many tables, then exact checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluvia.llm.common import checkpointed, connected_components, table
from fluvia.llm.neighbours import groups_of, matrix, valid_vectors

#: Tables, projections a table and the width of a quantum. At cosine 0.95 a pair shares no bucket with probability 0.003, at
#: 0.97 with 0.00002; a random pair shares one of a table with 0.000002.
TABLES, PROJECTIONS, WIDTH = 64, 18, 2.0
#: Vectors of a bucket that are compared as a block; a fuller bucket is compared block by block, in as many tasks.
TILE = 512


def hash_keys(v: np.ndarray, seed: int = 9) -> np.ndarray:
    """A key for each table of each vector (vectors x TABLES): hashes of the quantised projections."""
    r = np.random.default_rng([seed, v.shape[1]])
    a, b = r.normal(size=(v.shape[1], TABLES * PROJECTIONS)), r.uniform(0, WIDTH, TABLES * PROJECTIONS)
    mix = r.integers(1, 2**62, (1, TABLES, PROJECTIONS), dtype=np.int64) | 1
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    q = np.floor((unit @ a + b) / WIDTH).astype(np.int64).reshape(len(v), TABLES, PROJECTIONS)
    h = (q * mix).sum(2)
    h ^= h >> 29
    return (h * np.int64(0x2545F4914F6CDD1D) & ~np.int64(63)) + np.arange(TABLES) + np.int64(v.shape[1]) * 64


def _compare(v: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray | None, table_no: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of a tile that meet in no earlier table, as two arrays of positions."""
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    a, b = (left, left) if right is None else (left, right)
    dot = unit[a] @ unit[b].T >= least - 1e-9
    i, j = np.nonzero(np.triu(dot, 1) if right is None else dot)
    i, j = a[i], b[j]
    if len(i):
        # the measure itself, on the vectors as they are
        exact = np.einsum("ij,ij->i", v[i], v[j]) / (np.linalg.norm(v[i], axis=1) * np.linalg.norm(v[j], axis=1)) >= least
        i, j = i[exact], j[exact]
    if len(i) and table_no:
        used, back = np.unique(np.concatenate([i, j]), return_inverse=True)
        keys = hash_keys(v[used])
        new = np.empty(len(i), bool)
        for at in range(0, len(i), 1 << 16):
            s = slice(at, at + (1 << 16))
            new[s] = ~(keys[back[: len(i)][s], :table_no] == keys[back[len(i) :][s], :table_no]).any(1)
        i, j = i[new], j[new]
    return i, j


def _forest(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[list[int], list[int]]:
    """As few of the pairs as connect what all connect."""
    up = list(range(len(ids)))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    a, b = [], []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        p, q = top(x), top(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            a.append(int(ids[x]))
            b.append(int(ids[y]))
    return a, b


def linked(reps: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Of vectors (id, v, n: the rows that it stands for): (id, links to rows of others), and edges (a, b) that connect.

    Every pair that shares a bucket in any table is compared, and counted in the first table in which it does.
    """
    spark = reps.sparkSession

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(1).to_pylist()
            keys: list = [None] * len(rows)
            for dims in {len(r) for r in rows}:
                at = [k for k, r in enumerate(rows) if len(r) == dims]
                for s in range(0, len(at), 1024):
                    for k, own in zip(at[s : s + 1024], hash_keys(np.array([rows[k] for k in at[s : s + 1024]])).tolist(), strict=True):
                        keys[k] = own
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.list_(pa.int64()))], ["id", "keys"])

    keys = checkpointed(reps.select("id", "v").mapInArrow(keyed, "id bigint, keys array<bigint>"))
    placed = keys.select("id", F.posexplode("keys").alias("t", "key"))
    full = placed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key", F.ceil(F.col("m") / TILE).cast("int").alias("blocks"))
    met = placed.join(full, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int"))
    tiles = met.select("id", "t", "key", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tiles = tiles.select("id", "t", "key", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    order = ["key", "i", "j"]
    rows = tiles.join(reps, "id").repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), reps.count() * TABLES // 1_000_000), *order).sortWithinPartitions(*order, "id")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups_of(batches, order):
            if g.num_rows < 2:
                continue
            ids, v, n = g.column("id").to_numpy(), matrix(g.column("v")), g.column("n").to_numpy()
            own, x, y, t = g.column("own").to_numpy(), g.column("i")[0].as_py(), g.column("j")[0].as_py(), g.column("t")[0].as_py()
            i, j = _compare(v, n, np.flatnonzero(own == x), None if x == y else np.flatnonzero(own == y), t, least)
            if not len(i):
                continue
            links = (np.bincount(i, weights=n[j], minlength=len(ids)) + np.bincount(j, weights=n[i], minlength=len(ids))).astype(np.int64)
            has, (a, b) = np.flatnonzero(links), _forest(ids, i, j)
            none = [None] * len(a)
            yield pa.RecordBatch.from_arrays([pa.array([*ids[has].tolist(), *none], pa.int64()), pa.array([*links[has].tolist(), *none], pa.int64()), pa.array([None] * len(has) + a, pa.int64()), pa.array([None] * len(has) + b, pa.int64())], ["id", "links", "a", "b"])

    found = checkpointed(rows.select("id", "v", "n", "t", "own", *order).mapInArrow(compared, "id bigint, links bigint, a bigint, b bigint"))
    return found.where("id IS NOT NULL").groupBy("id").agg(F.sum("links").alias("links")), found.where("a IS NOT NULL").select("a", "b")


def vector_groups(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.95) -> DataFrame:
    """(id, n_links, component_id, kept) of every row; vectors of cosine `least` or more link, copies too.

    Vectors that are null, zero or hold null or non-finite components, and rows without an id, link with nothing. Vectors of
    different lengths never link. Copies stand as one class, which is named by the hash of its components, not by an id; so a
    row that repeats an id counts as a vector of its own, and n_links counts rows.
    """
    good = checkpointed(valid_vectors(rows, id_col, vec_col).withColumn("cls", F.xxhash64("v")))
    # of different vectors of one hash each has a class: the second to come in order takes the next number, and so on
    named = good.groupBy("cls", "v").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
    several = named.groupBy("cls").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("cls")
    if not several.isEmpty():
        apart = Window.partitionBy("cls").orderBy("v")  # as many rows as vectors share a hash
        again = named.join(several, "cls").withColumn("k", F.row_number().over(apart) - 1)
        named = named.join(several, "cls", "left_anti").unionByName(again.select((F.col("cls") + F.col("k")).alias("cls"), "v", "low", "n"))
    classes = checkpointed(named)
    reps = classes.select(F.col("cls").alias("id"), "v", "n")
    links, edges = linked(reps, least)
    comps = connected_components(edges)
    of = classes.select("cls", "v", "low", "n").join(links, F.col("cls") == F.col("id"), "left").drop("id").join(comps, F.col("cls") == F.col("node"), "left")
    of = checkpointed(of.select("v", "low", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component"))
    linked_rows, alone = of.where("component IS NOT NULL"), of.where("component IS NULL")
    lowest = checkpointed(linked_rows.groupBy("component").agg(F.min("low").alias("component_id")))
    named = checkpointed(linked_rows.join(lowest, "component").select("v", "n_links", "component_id").unionByName(alone.select("v", "n_links", F.col("low").alias("component_id"))))
    inside = good.join(named, "v").select("id", "n_links", "component_id")
    v = F.col(vec_col).cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    left = rows.where(~F.coalesce(ok, F.lit(False)) | F.col(id_col).isNull()).select(F.col(id_col).alias("id"), F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"))
    return inside.unionByName(left).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.95."""
    return vector_groups(table(spark, sf_dir, "embeddings"))
