"""Approximate nearest neighbours: inverted lists whose candidates are scanned a block of rotated dimensions at a time."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluvia.llm.common import checkpointed, table

#: Vectors that the lists' centres and the number of probed lists are fitted on at most, those whose ids hash lowest.
SAMPLE = 8192
#: Vectors of a list that one task scans together; longer lists are split into so many parts.
PART = 4096
#: Dimensions of a column block, and the number of standard errors that the test for abandoning allows.
BLOCK, EPSILON = 16, 2.6
#: Candidates between two updates of a scan's bound.
STEP = 512


def valid_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v array<double>) of rows that take part: an id, and a vector with finite components, not all zero."""
    v = F.col(vec_col).cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.select(F.col(id_col).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ok)


def rotation(dims: int, seed: int = 5) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))[0]


def centres(sample: np.ndarray, count: int, rounds: int = 8, seed: int = 2) -> np.ndarray:
    c = sample[np.random.default_rng(seed).permutation(len(sample))[:count]].copy()
    for _ in range(rounds):
        near = (((c**2).sum(1))[None] - 2 * sample @ c.T).argmin(1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def ranked(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Lists of each vector, nearest centre first."""
    return np.argsort((c**2).sum(1)[None] - 2 * v @ c.T, axis=1, kind="stable")


def probes(sample: np.ndarray, c: np.ndarray, k: int, recall: float, seed: int = 4) -> int:
    """Lists to probe so that of the sample's own nearest neighbours at least a share of `recall` lies in them, and two
    standard errors more. Among more vectors the nearest are nearer still, so their lists rank no later.

    Asked are 256 of the sample's distinct vectors, drawn at random, about their neighbours among the distinct ones: copies lie
    in one list and would make the number look small.
    """
    sample = np.unique(sample, axis=0)
    asked = np.random.default_rng(seed).permutation(len(sample))[:256]
    q = sample[asked]
    d = (sample**2).sum(1)[None] - 2 * q @ sample.T
    d[np.arange(len(q)), asked] = np.inf
    near = np.argsort(d, axis=1)[:, : min(k, len(sample) - 1)]
    rank = np.argsort(ranked(q, c), axis=1)  # of each list for each query
    home = ranked(sample, c)[:, 0]
    at = rank[np.arange(len(q))[:, None], home[near]]
    if not at.size:
        return len(c)
    for n in range(1, len(c)):
        share = (at < n).mean(1)  # of each query
        if share.mean() - 2 * share.std() / np.sqrt(len(q)) >= recall:
            return n
    return len(c)


def scan(keys: np.ndarray, ids: np.ndarray, base: np.ndarray, turned: np.ndarray, query: np.ndarray, q_turned: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the k nearest of a part to one query, but for the row whose key is its own.

    The nearest so far give a bound, which tightens after each STEP candidates; of the next, those whose distance in the first
    blocks of rotated dimensions is too large for the bound, by a test on its scaled value, are abandoned.
    """
    dims, live = base.shape[1], np.flatnonzero(keys != own)
    best, d = live[: 8 * k], ((base[live[: 8 * k]] - query) ** 2).sum(1)
    for s in range(8 * k, len(live), STEP):
        rest, partial = live[s : s + STEP], 0.0
        bound = np.partition(d, k - 1)[k - 1]
        for at in range(0, dims, BLOCK):
            cols = slice(at, min(dims, at + BLOCK))
            partial = partial + ((turned[rest, cols] - q_turned[cols]) ** 2).sum(1)
            seen = cols.stop
            if seen < dims:
                keep = partial * (dims / seen) <= bound * (1 + EPSILON / np.sqrt(seen)) ** 2 * (1 + 1e-9)
                rest, partial = rest[keep], partial[keep]
        if len(rest):
            best, d = np.concatenate([best, rest]), np.concatenate([d, ((base[rest] - query) ** 2).sum(1)])
            top = np.lexsort((ids[best], d))[:k]
            best, d = best[top], d[top]
    top = np.lexsort((ids[best], d))[:k]
    return best[top], np.sqrt(d[top])


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, from batches that are sorted by it; a group is held whole, so groups must be bounded."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.any([c[1:] != c[:-1] for c in cols], axis=0)
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[s] for c in cols)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1).astype(float)


def nearest(base: DataFrame, asks: Column, k: int = 10, recall: float = 0.97, lists: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of base found for each of its rows that meet asks, that row excepted.

    base holds id and v (see valid_vectors). Nearest by Euclidean distance in double precision, ties to the smaller id. Every row
    is a vector of its own: rows that repeat an id find each other, and each of them that asks gets ranks of its own. Vectors of
    different lengths have no distance, so each length is searched apart. Without rows, or rows that ask, there are no results.
    """
    spark = base.sparkSession
    base = checkpointed(base.select("id", "v", F.coalesce(asks, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("row")))
    lengths = sorted(r[0] for r in base.select(F.size("v")).distinct().collect())
    if not lengths:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    found = [_nearest(base.where(F.size("v") == n) if len(lengths) > 1 else base, k, recall, lists) for n in lengths]
    return functools.reduce(DataFrame.unionByName, found)


def _nearest(base: DataFrame, k: int, recall: float, lists: int | None) -> DataFrame:
    spark = base.sparkSession
    total = base.count()
    got = base.select("row", "id", "v").orderBy(F.xxhash64("id"), "id", "row").limit(SAMPLE).collect()
    sample = np.array([r["v"] for r in sorted(got, key=lambda r: (r["id"], r["row"]))])
    dims = sample.shape[1]
    count = min(len(sample), lists or max(1, int(2 ** np.round(np.log2(max(1.0, np.sqrt(total) / 4))))))
    c = centres(sample, count)
    n_probe, turn = probes(sample, c, k, recall), rotation(dims)

    def vectors(b: pa.RecordBatch) -> np.ndarray:
        return matrix(pa.chunked_array([b.column("v")])) if b.num_rows else np.zeros((0, dims))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = pa.array(ranked(v, c)[:, 0] if len(v := vectors(b)) else [], pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("row", "id", "v", "asks")), own], ["row", "id", "v", "asks", "list"])

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            order = ranked(v, c) if len(v := vectors(b)) else np.zeros((0, len(c)), int)
            # further lists where the probed ones hold fewer than k besides the query itself
            enough = np.maximum(n_probe, (np.cumsum(filled[order], axis=1) <= k).sum(1) + 1)
            near = [r[:n].tolist() for r, n in zip(order.astype(np.int32), enough.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("row", "id", "v")), pa.array(near, pa.list_(pa.int32()))], ["row", "id", "v", "lists"])

    held = checkpointed(base.mapInArrow(listed, "row bigint, id bigint, v array<double>, asks boolean, list int"))
    sizes = held.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))  # a row a list
    filled = np.zeros(len(c), np.int64)  # a number a list
    for r in held.groupBy("list").count().collect():
        filled[r["list"]] = r["count"]
    in_parts = held.join(F.broadcast(sizes), "list").select("list", F.pmod(F.xxhash64("row"), F.col("parts").cast("long")).cast("int").alias("part"), F.lit(0).alias("q"), "row", "id", "v")
    asked = held.where("asks").select("row", "id", "v").mapInArrow(probed, "row bigint, id bigint, v array<double>, lists array<int>").select("row", "id", "v", F.explode("lists").alias("list")).join(F.broadcast(sizes), "list")
    asked = asked.select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("q"), "row", "id", "v")
    order = ["list", "part"]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A part's vectors come before the queries that ask it; those are answered as they come, so they need not be held."""
        part, parts, held_part = None, [], None
        for batch in batches:
            for g in groups_of(iter([batch]), [*order, "q"]):
                now, g = (g.column("list")[0].as_py(), g.column("part")[0].as_py()), g.combine_chunks()
                if now != part:
                    part, parts, held_part = now, [], None
                if g.column("q")[0].as_py() == 0:
                    parts.append((g.column("row").to_numpy(), g.column("id").to_numpy(), matrix(g.column("v"))))
                    continue
                if not parts:
                    continue
                if held_part is None:
                    held_part = [np.concatenate(x) for x in zip(*parts, strict=True)]
                    held_part.append(held_part[2] @ turn)
                keys, ids, b, turned = held_part
                rows, q = [], matrix(g.column("v"))
                for own, own_id, x, xt in zip(g.column("row").to_pylist(), g.column("id").to_pylist(), q, q @ turn, strict=True):
                    near, d = scan(keys, ids, b, turned, x, xt, own, k)
                    rows.append((np.full(len(near), own), np.full(len(near), own_id), ids[near], keys[near], d))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows, strict=True)], ["row", "query_id", "vec_id", "other", "score"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    joined = in_parts.unionByName(asked).repartition(max(parts, total // 20_000), *order).sortWithinPartitions(*order, "q", "id")
    hits = joined.mapInArrow(found, "row bigint, query_id bigint, vec_id bigint, other bigint, score double")
    # a bounded rank: what a task can rule out doesn't leave it
    rank = F.row_number().over(Window.partitionBy("row").orderBy("score", "vec_id", "other"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all embeddings for each row whose vec_id is divisible by 100."""
    return nearest(valid_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), F.col("id") % 100 == 0)
