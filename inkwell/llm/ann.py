"""Approximate nearest neighbours by cross-polytope hashing.

A vector is scaled to unit length with one more coordinate (the inner-product to cosine reduction: candidates
get sqrt(M^2 - |x|^2), queries 0, M the largest norm), padded to a power of two and turned by three rounds of
random signs and fast Hadamard transform. The nearest signed axis is its hash; a bucket is the hashes of `depth`
rotations, and depth grows with the logarithm of the number of points, so that buckets don't. A query probes the
buckets with the largest sums of its coordinates in each of `tables` tables. How many is fitted: a bounded sample of
queries is searched exactly, and the fewest probes are taken that find TARGET of their neighbours (a lesser depth,
if no number does; at depth 1 all buckets are an exact search).

Points and queries meet in groups of buckets: a point goes to one group of a table, a query once to each group that
holds a probed bucket, with the list of these. Groups of too many points or queries are dealt to several tasks. In a
task each bucket is one matrix product, of which a query's best few stay, never the pairs; their exact inner products
rank them.

Equal vectors are one point that carries its `k + 1` smallest ids (more can't be in a result), so a vector
that a third of the rows share costs one point. Queries that found fewer than k rows probe every bucket of one table
of depth 1, which is an exact search.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.llm.common import bounded_batches, cut

#: Production parameters; recall against brute force is in the README. Tables; share of the neighbours of SAMPLE queries
#: that must be found; points in a bucket from which one more rotation is taken; most probes of a table.
TABLES, TARGET, SAMPLE, BUCKET_ROWS, MOST_PROBES, SEED = 4, 0.97, 256, 2000, 1024, 11
#: Points and queries in one task.
GROUP_ROWS, QUERY_ROWS = 40_000, 40_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal fast Walsh-Hadamard transform of each row (a power of two of columns)."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def _turned(x: np.ndarray, table: int, level: int, seed: int) -> np.ndarray:
    """The coordinates of each row on the signed axes of a rotation."""
    rng = np.random.default_rng([seed, table, level, x.shape[1]])
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], x.shape[1]))
    return np.concatenate([x, -x], axis=1)


def bucket(x: np.ndarray, table: int, depth: int, seed: int = SEED) -> np.ndarray:
    """The bucket of each row: its nearest signed axes, as digits."""
    out = np.zeros(len(x), dtype=np.int64)
    for level in range(depth):
        out = out * (2 * x.shape[1]) + _turned(x, table, level, seed).argmax(axis=1)
    return out


def probed(x: np.ndarray, table: int, depth: int, probes: int, seed: int = SEED) -> np.ndarray:
    """The buckets that each row probes, the likeliest first: those of the largest sums of coordinates."""
    out, total = np.zeros((len(x), 1), dtype=np.int64), np.zeros((len(x), 1))
    for level in range(depth):
        s = _turned(x, table, level, seed)
        top = np.argsort(-s, axis=1, kind="stable")[:, :probes]  # of the sums, the best have both parts among the best
        sums = (total[:, :, None] + np.take_along_axis(s, top, 1)[:, None, :]).reshape(len(x), -1)
        codes = (out[:, :, None] * s.shape[1] + top[:, None, :]).reshape(len(x), -1)
        first = np.argsort(-sums, axis=1, kind="stable")[:, :probes]
        out, total = np.take_along_axis(codes, first, 1), np.take_along_axis(sums, first, 1)
    return out


def _lifted(v: np.ndarray, largest: float, query: bool) -> np.ndarray:
    """Unit vectors of a power-of-two dimension whose order of cosines with a query is that of inner products."""
    n, d = v.shape
    out = np.zeros((n, 1 << d.bit_length()))  # > d: room for the extra coordinate
    norm = np.sqrt((v * v).sum(axis=1))
    if query:
        out[:, :d] = v / norm[:, None]
    else:
        out[:, :d] = v / largest
        out[:, d] = np.sqrt(np.maximum(0.0, 1.0 - (norm / largest) ** 2))
    return out


def _by_size(batches):
    """(number of dimensions, ids, vectors) of each batch, at most 256 rows at once."""
    for b in batches:
        for d, part in b.groupby(b["vector"].map(len)):
            for at in range(0, len(part), 256):
                some = part.iloc[at : at + 256]
                yield int(d), some["id"].to_numpy(), np.stack(some["vector"].to_numpy()).astype(np.float64)


def _group(code: np.ndarray, groups: int) -> np.ndarray:
    return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % groups


_SHAPE = "id bigint, vec binary, d int, t int, g bigint, b array<bigint>"


def _hashed(df: DataFrame, largest: float, query: bool, how: dict[int, tuple[int, int, int]], tables: int, seed: int, packed: str) -> DataFrame:
    """id, vec, d, t, g, b: a row for each table (points) or each group of a table (queries) with the buckets in it.

    how: number of dimensions -> (depth, probes, groups). packed: how vectors are written, as a numpy type.
    """

    def run(batches):
        for d, ids, v in _by_size(batches):
            if d not in how:
                continue
            depth, probes, groups = how[d]
            x = _lifted(v, largest, query)
            raw = [r.tobytes() for r in v.astype(packed)]
            for t in range(tables):
                b = probed(x, t, depth, min(probes, (2 * x.shape[1]) ** depth), seed) if query else bucket(x, t, depth, seed)[:, None]
                g = _group(b, groups)
                order = np.argsort(g, axis=1, kind="stable")
                g, b = np.take_along_axis(g, order, 1), np.take_along_axis(b, order, 1)
                new = np.concatenate([np.ones((len(g), 1), dtype=bool), g[:, 1:] != g[:, :-1]], axis=1)
                row, start = np.nonzero(new)
                flat, at = b.reshape(-1), row * b.shape[1] + start
                ends = np.append(at[1:], len(flat))
                yield pd.DataFrame({"id": ids[row], "vec": [raw[i] for i in row.tolist()], "d": np.int32(d), "t": np.int32(t), "g": g[row, start], "b": [flat[i:j] for i, j in zip(at.tolist(), ends.tolist(), strict=True)]})

    return df.select("id", "vector").mapInPandas(run, _SHAPE)


def _merge(score: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The best `keep` of each row, ties to the smaller id."""
    order = np.lexsort((ids, -score), axis=1)
    score, ids = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)
    return score[:, :keep], ids[:, :keep]


def _best(points: DataFrame, queries: DataFrame, keep: int, packed: str) -> DataFrame:
    """q, id, score: the best `keep` points of each query in each task (d, t, g, part, qpart) that both are in."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        read = lambda v: np.frombuffer(b"".join(v), dtype=packed).reshape(len(v), -1).astype(np.float64)
        code = np.array([b[0] for b in left["b"]])
        order = np.lexsort((left["id"].to_numpy(), code))
        x, ids, code = read(left["vec"].to_list())[order], left["id"].to_numpy()[order], code[order]
        y, asked = read(right["vec"].to_list()), right["id"].to_numpy()
        who = np.repeat(np.arange(len(asked)), [len(b) for b in right["b"]])
        wants = np.concatenate(right["b"].to_list())
        order = np.argsort(wants, kind="stable")
        who, wants = who[order], wants[order]
        best, found = np.full((len(asked), keep), -np.inf), np.full((len(asked), keep), -1, dtype=np.int64)
        names, begins = np.unique(code, return_index=True)
        for c, i, j in zip(names.tolist(), begins.tolist(), [*begins.tolist()[1:], len(code)], strict=True):
            a, z = np.searchsorted(wants, [c, c + 1])
            for at in range(a, z, 512):
                mine = who[at : min(z, at + 512)]
                s = y[mine] @ x[i:j].T
                k = min(keep + 8, j - i)
                top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < j - i else np.tile(np.arange(k), (len(mine), 1))
                exact = (y[mine][:, None, :] * x[i:j][top]).sum(axis=2)  # one order of summing, so equal in every task
                best[mine], found[mine] = _merge(np.concatenate([best[mine], exact], axis=1), np.concatenate([found[mine], ids[i:j][top]], axis=1), keep)
        r, c = np.nonzero(np.isfinite(best))
        return pd.DataFrame({"q": asked[r], "id": found[r, c], "score": best[r, c]})

    key = ["d", "t", "g", "part", "qpart"]
    return points.groupBy(*key).cogroup(queries.groupBy(*key)).applyInPandas(run, "q bigint, id bigint, score double")


def _meet(points: DataFrame, queries: DataFrame, keep: int, packed: str) -> DataFrame:
    """_best over the groups, those of many points or queries in several tasks."""
    key = ["d", "t", "g"]
    # a row for each GROUP_ROWS points or so
    sizes = points.groupBy(*key).agg(F.ceil(F.count("*") / (1.5 * GROUP_ROWS)).cast("int").alias("parts"))
    sizes = cut(sizes.join(queries.groupBy(*key).agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("qparts")), key))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = points.join(sizes, key).withColumn("part", deal("parts")).withColumn("qpart", every("qparts")).drop("parts", "qparts")
    asked = queries.join(sizes, key).withColumn("qpart", deal("qparts")).withColumn("part", every("parts")).drop("parts", "qparts")
    return _best(dealt, asked, keep, packed)


def _few(df: DataFrame, n: int, total: int) -> DataFrame:
    """The rows of least id hash, about n of `total` of them."""
    if total <= n:
        return df
    return df.where(F.shiftrightunsigned(F.xxhash64("id", F.lit(SEED)), 1).cast("double") <= (n / total) * float(1 << 63))


def fitted(points: DataFrame, queries: DataFrame, largest: float, counts: dict[int, int], k: int, tables: int, seed: int) -> dict[int, tuple[int, int, int]]:
    """Number of dimensions -> (depth, probes, groups). A sample of queries of at most about SAMPLE rows is searched exactly, in one pass over the points."""
    asked_n = queries.count()
    sample: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    got = _few(queries.select("id", "vector"), SAMPLE, asked_n).limit(2 * SAMPLE).collect()
    for d in {len(r["vector"]) for r in got}:
        own = [r for r in got if len(r["vector"]) == d]
        sample[d] = np.array([r["id"] for r in own]), np.array([list(r["vector"]) for r in own], dtype=np.float64)

    def run(batches):
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        kept: dict[int, dict[int, np.ndarray]] = {}
        for d, ids, v in _by_size(batches):
            if d not in sample:
                continue
            y = sample[d][1]
            score = y @ v.T
            score[(y[:, None, 0] == v[None, :, 0]) & (np.abs(score - (y * y).sum(axis=1)[:, None]) < 1e-12)] = -np.inf  # itself
            old = best.get(d, (np.full((len(y), 0), 0.0), np.full((len(y), 0), 0)))
            best[d] = _merge(np.concatenate([old[0], score], axis=1), np.concatenate([old[1], np.tile(ids, (len(y), 1))], axis=1), k)
            have = kept.setdefault(d, {})
            have |= zip(ids.tolist(), v, strict=True)
            if len(have) > 50_000:
                alive = set(best[d][1].reshape(-1).tolist())
                kept[d] = {i: x for i, x in have.items() if i in alive}
        for d, (score, ids) in best.items():
            r, c = np.nonzero(np.isfinite(score))
            yield pd.DataFrame({"d": np.int32(d), "q": sample[d][0][r], "score": score[r, c], "vector": [kept[d][i] for i in ids[r, c].tolist()]})

    w = Window.partitionBy("q").orderBy(F.desc("score"))
    near = points.select("id", "vector").mapInPandas(run, "d int, q bigint, score double, vector array<double>")
    near = near.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).collect() if sample else []  # k rows for each of the sample
    out = {}
    for d, n in counts.items():
        wide = 2 << d.bit_length()
        depth = max(1, int(np.ceil(np.log(max(1.0, n / BUCKET_ROWS)) / np.log(wide))))
        groups = -(-n // GROUP_ROWS)
        pairs = [r for r in near if r["d"] == d]
        if not pairs:
            out[d] = (1, wide, groups)
            continue
        place = {i: x for x, i in enumerate(sample[d][0].tolist())}
        x = _lifted(sample[d][1], largest, True)
        v = _lifted(np.array([list(r["vector"]) for r in pairs]), largest, False)
        who = np.array([place[r["q"]] for r in pairs])
        while True:
            most = min(MOST_PROBES, wide**depth)
            rank = np.full(len(pairs), most)
            for t in range(tables):
                hit = probed(x, t, depth, most, seed)[who] == bucket(v, t, depth, seed)[:, None]
                rank = np.minimum(rank, np.where(hit.any(axis=1), hit.argmax(axis=1), most))
            need = int(np.sort(rank)[int(np.ceil(TARGET * len(rank))) - 1]) + 1
            if need <= most or depth == 1:
                out[d] = (depth, min(need, most), groups)
                break
            depth -= 1
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", tables: int = TABLES, seed: int = SEED) -> DataFrame:
    """The k rows of `vectors` nearest to each query row found: query_id, rank (from 1), vec_id, score.

    Nearness is the inner product in double precision, ties to the smaller id; a query's own id is never in its
    result. Rows take no part if id or vector is null, or if the vector is empty, zero or holds null or
    non-finite components. Of rows with one id the least vector counts. Vectors of other length than the
    query's are no candidates. Where there are fewer candidates than k, all are returned; empty tables give an
    empty result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(f"`{vector_column}`").cast("array<double>")
        ok = F.size(v) > 0
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.select(F.col(f"`{id_column}`").cast("long").alias("id"), v.alias("vector")).where(F.col("id").isNotNull() & ok & F.coalesce(fine, F.lit(False)))

    def single(df: DataFrame) -> DataFrame:
        return df.groupBy("id").agg(F.min("vector").alias("vector"))

    points, asked = single(clean(vectors)), single(clean(queries))
    # equal vectors: the limit by row_number goes below the shuffle, so a hot vector sends k + 1 ids a task
    few = points.withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("n") <= k + 1)
    groups = cut(few.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("id", F.col("ids")[0]))
    distinct_asked = cut(asked.groupBy("vector").agg(F.min("id").alias("id")))
    about = groups.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))).alias("norm")).collect()  # a row for each number of dimensions
    if not about:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    largest = max(r["norm"] for r in about) * (1 + 1e-12)
    packed = "<f4" if dict(vectors.dtypes)[vector_column] == "array<float>" else "<f8"
    how = fitted(groups, distinct_asked, largest, {r["d"]: r["n"] for r in about}, k, tables, seed)
    hashed = _hashed(groups, largest, False, how, tables, seed, packed)

    def rows_of(found: DataFrame) -> DataFrame:
        """The k + 1 best ids of each distinct query."""
        best = found.groupBy("q", "id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
        best = best.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n")
        ids = best.join(groups.select("id", "ids"), "id").select("q", "score", F.explode("ids").alias("id"))
        ids = ids.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
        return ids.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("n", "score", "id"))).alias("found"))

    near = cut(rows_of(_meet(hashed, _hashed(distinct_asked, largest, True, how, tables, seed, packed), k + 1, packed)))
    short = distinct_asked.join(near.where(F.size("found") > k).select(F.col("q").alias("id")), "id", "left_anti")
    if not short.isEmpty():
        every = {d: (1, 2 << d.bit_length(), groups_) for d, (_, _, groups_) in how.items()}
        again = rows_of(_meet(_hashed(groups, largest, False, every, 1, seed, packed), _hashed(short, largest, True, every, 1, seed, packed), k + 1, packed))
        near = near.where(F.size("found") > k).unionByName(again)

    mine = asked.withColumnRenamed("id", "query_id").join(distinct_asked.withColumnRenamed("id", "q"), "vector").select("query_id", "q")
    own = F.slice(F.filter("found", lambda r: r["id"] != F.col("query_id")), 1, k)
    return (
        mine.join(near, "q")
        .select("query_id", F.posexplode(own).alias("at", "r"))
        .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("r.id").alias("vec_id"), F.col("r.score").alias("score"))
    )


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every embedding whose id is divisible by 20."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
