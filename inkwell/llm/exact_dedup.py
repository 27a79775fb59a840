"""Exact deduplication by composable polynomial fingerprints.

The fingerprint of a byte string s is, in each of four lanes (prime p, base B), the sum of (s[i] + 1) * B^(n-1-i)
mod p, with the length n beside it: 124 bits of hash. Fingerprints compose: that of xy is f(x) * B^|y| + f(y), so
chunks hash in parallel and combine by length-shifted arithmetic. In a worker the chunks of a text are one matrix
product (exact in doubles, as every sum stays below 2^53); a text over HUGE_BYTES is first cut into parts that
hash as rows of their own, in any tasks.

Rows of one fingerprint are then compared with the row that stays, chunk by chunk. A row that differs (a
collision) moves to a group of its own kind and is compared again, until every group holds equal texts only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import apart, cut, drop, id_keys, map_rows, one_of_each

#: Primes below 2^31 and bases of the four lanes.
PRIMES = np.array([2147483647, 2147483629, 2147483587, 2147483579], dtype=np.int64)
BASES = np.array([911382323, 972663749, 1234567891, 1618033988], dtype=np.int64)
#: Bytes in a chunk of a matrix product; of a text that is hashed in parts, and of a part; of a compared chunk.
CHUNK, HUGE_BYTES, COMPARED = 4096, 4 << 20, 1 << 16

_KEY = ["n_bytes", "f1", "f2"]


def _powers(n: int) -> np.ndarray:
    """BASES^n mod PRIMES."""
    return np.array([pow(int(b), n, int(p)) for b, p in zip(BASES, PRIMES, strict=True)], dtype=np.int64)


def _table() -> np.ndarray:
    t = np.empty((CHUNK, 4))
    x = np.ones(4, dtype=np.int64)
    for i in range(CHUNK - 1, -1, -1):
        t[i] = x
        x = x * BASES % PRIMES
    return t


_POWERS = _table()


def combine(left: np.ndarray, right: np.ndarray, right_bytes: int) -> np.ndarray:
    """The lanes of xy from those of x and y, and the length of y."""
    return (left * _powers(right_bytes) + right) % PRIMES


def lanes(data: bytes) -> np.ndarray:
    """The four lanes of a byte string; chunks hash together and combine pairwise."""
    if not data:
        return np.zeros(4, dtype=np.int64)
    k = -(-len(data) // CHUNK)
    x = np.zeros(k * CHUNK)  # zeros in front leave a polynomial as it is
    x[k * CHUNK - len(data) :] = np.frombuffer(data, dtype=np.uint8)
    x[k * CHUNK - len(data) :] += 1
    h = (x.reshape(k, CHUNK) @ _POWERS).astype(np.int64) % PRIMES
    shift = _powers(CHUNK)
    while len(h) > 1:
        if len(h) % 2:
            h = np.concatenate([np.zeros((1, 4), dtype=np.int64), h])
        h = (h[0::2] * shift + h[1::2]) % PRIMES
        shift = shift * shift % PRIMES
    return h[0]


def _packed(h: np.ndarray) -> tuple[int, int]:
    return int(h[0]) << 31 | int(h[1]), int(h[2]) << 31 | int(h[3])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", huge_bytes: int = HUGE_BYTES) -> DataFrame:
    """id, text_sha256, n_bytes, f1, f2, copies: the distinct (id, text) rows and how often each occurs. A null text counts as empty."""
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), text.alias("text"))
    sha, size = F.sha2("text", 256), F.octet_length("text").cast("long")

    def whole(b: dict[str, list]) -> dict[str, list]:
        f = [_packed(lanes(x or b"")) for x in b["data"]]
        return {"id": b["id"], "text_sha256": b["sha"], "n_bytes": b["size"], "f1": [x[0] for x in f], "f2": [x[1] for x in f]}

    schema = pa.schema([("id", pa.int64()), ("text_sha256", pa.string()), ("n_bytes", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64())])
    small = map_rows(rows.where(F.octet_length("text") <= huge_bytes), {"id": "id", "sha": sha, "size": size, "data": F.col("text").cast("binary")}, whole, schema)
    small = small.groupBy("id", "text_sha256", *_KEY).agg(F.count("*").alias("copies"))

    # parts of huge texts: rows (id, sha, size, part, data), each hashed wherever it lands
    data = F.col("text").cast("binary")
    starts = F.sequence(F.lit(0).cast("long"), size - 1, F.lit(huge_bytes).cast("long"))
    cutup = F.transform(starts, lambda s: F.substring(data, (s + 1).cast("int"), F.lit(huge_bytes)))
    parts = rows.where(F.octet_length("text") > huge_bytes).select("id", sha.alias("sha"), size.alias("size"), F.posexplode(cutup).alias("part", "data"))
    parts = parts.repartition("sha", "part")

    def part(b: dict[str, list]) -> dict[str, list]:
        return {n: b[n] for n in ("id", "sha", "size", "part")} | {"h": [lanes(x).tolist() for x in b["data"]], "bytes": [len(x) for x in b["data"]]}

    fields = pa.schema([("id", pa.int64()), ("sha", pa.string()), ("size", pa.int64()), ("part", pa.int32()), ("h", pa.list_(pa.int64())), ("bytes", pa.int64())])
    hashed = map_rows(parts, {n: n for n in ("id", "sha", "size", "part", "data")}, part, fields)
    # equal rows give equal parts: one of each counts; a text has at most 2 GB / huge_bytes parts
    once = hashed.groupBy("id", "sha", "size", "part").agg(F.first("h").alias("h"), F.first("bytes").alias("bytes"), F.count("*").alias("copies"))
    lists = once.groupBy("id", "sha", "size").agg(F.array_sort(F.collect_list(F.struct("part", "h", "bytes"))).alias("parts"), F.max("copies").alias("copies"))

    def join(b: dict[str, list]) -> dict[str, list]:
        out = []
        for ps in b["parts"]:
            h = np.zeros(4, dtype=np.int64)
            for p in ps:
                h = combine(h, np.array(p["h"], dtype=np.int64), p["bytes"])
            out.append(_packed(h))
        return {"id": b["id"], "text_sha256": b["sha"], "n_bytes": b["size"], "f1": [x[0] for x in out], "f2": [x[1] for x in out], "copies": b["copies"]}

    large = map_rows(lists, {n: n for n in ("id", "sha", "size", "parts", "copies")}, join, schema.append(pa.field("copies", pa.int64())))
    return small.unionByName(large)


def _equal(a: Column, b: Column) -> Column:
    """Chunkwise comparison of two binary columns of one length."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(a) / COMPARED)).cast("int")
    chunk = lambda x, i: F.substring(x, i * COMPARED + 1, F.lit(COMPARED))
    return (F.octet_length(a) == F.octet_length(b)) & F.forall(F.sequence(F.lit(0), n - 1), lambda i: chunk(a, i) == chunk(b, i))


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", huge_bytes: int = HUGE_BYTES, mask: int = -1) -> DataFrame:
    """A row for each row of docs: the id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty. Of equal texts the row with the largest id stays;
    group_size counts the rows of the group, repeated rows included, of which one is kept. Rows with a null id
    stay only where no row of the group has an id (keep_id is then null). Empty tables give empty ones; other
    columns are ignored. mask: bits of the fingerprint to use (tests force collisions with few).
    """
    prints = cut(fingerprints(docs, id_column, text_column, huge_bytes).withColumns({"f1": F.col("f1").bitwiseAND(mask), "f2": F.col("f2").bitwiseAND(mask), "n_bytes": F.col("n_bytes").bitwiseAND(mask), "turn": F.lit(0)}))
    key = [*_KEY, "turn"]
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    source = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), text.alias("text"))

    todo = prints  # rows whose groups have not been compared
    while True:
        groups = todo.groupBy(*key).agg(F.max("id").alias("keep_id"), F.max_by("text_sha256", F.coalesce("id", F.lit(-(1 << 63)))).alias("keep_sha"), F.count("*").alias("n")).where("n > 1")
        groups = apart(groups)
        members = todo.join(groups, key).select("id", "text_sha256", *key, "keep_id", "keep_sha")
        texts = source.join(members, source["id"].eqNullSafe(members["id"]) & (F.sha2(source["text"], 256) == members["text_sha256"])).select(members["id"], "text_sha256", *key, "keep_id", "keep_sha", F.col("text").cast("binary").alias("data"))
        texts = texts.withColumn("stays", F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("text_sha256") == F.col("keep_sha")))
        stays = apart(texts.where("stays").select(*key, F.col("data").alias("other")).groupBy(*key).agg(F.first("other").alias("other")))
        # made distinct after the cut: an aggregation right above the join would keep a hot group in one task
        unlike = cut(texts.where("NOT stays").join(stays, key).where(~_equal(F.col("data"), F.col("other"))).select("id", "text_sha256", *key)).distinct()
        if unlike.isEmpty():
            break
        moved = [F.col("id").eqNullSafe(F.col("u.id")), *(F.col(f"p.{c}") == F.col(f"u.{c}") for c in ("text_sha256", *key))]
        on = F.col("p.id").eqNullSafe(F.col("u.id"))
        for c in moved[1:]:
            on = on & c
        flag = prints.alias("p").join(unlike.withColumn("hit", F.lit(1)).alias("u"), on, "left")
        old = prints
        prints = cut(flag.select("p.id", "p.text_sha256", *(f"p.{c}" for c in _KEY), "p.copies", (F.col("p.turn") + F.coalesce("u.hit", F.lit(0))).alias("turn")))
        drop(old)
        last = prints.agg(F.max("turn")).first()[0]
        todo = prints.where(F.col("turn") == last)

    sizes = apart(prints.groupBy(*key).agg(F.max("id").alias("keep_id"), F.sum("copies").alias("group_size")))
    rows = prints.join(sizes, key).select("id", "text_sha256", "keep_id", "group_size", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    # rows without any id: one of the group's copies is kept; equal texts have one row in prints for each id
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return rows.select(F.col("id").alias(id_column), "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def keep_rows(docs: DataFrame, decisions: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs, with their own columns, that exact_duplicates keeps; of repeated rows one."""
    sha = F.sha2(F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")), 256)
    k1, k2 = id_keys(F.col(f"`{id_column}`").cast("long"))
    rows = one_of_each(docs, own_id=k1, own_null=k2, own_sha=sha)
    k1, k2 = id_keys(F.col(id_column))
    kept = decisions.where("kept").select(k1.alias("own_id"), k2.alias("own_null"), F.col("text_sha256").alias("own_sha"))
    return rows.join(kept, ["own_id", "own_null", "own_sha"], "left_semi").select("row.*")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact-duplicate decision of every document."""
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
