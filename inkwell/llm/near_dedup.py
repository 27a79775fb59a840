"""MinHash near-duplicate detection with odd sketches.

1. One pass makes each text's set of 64-bit shingle hashes, BANDS x ROWS MinHash samples, the band keys and an
   odd sketch: each sample toggles a bit of a bitmap, so the XOR of two bitmaps has about as many ones as the
   samples that differ, and its population count estimates a high Jaccard similarity closely.
2. Documents with equal sets (by size and a 128-bit hash) are one class (one node), however many copies there are.
3. Classes meet in band buckets; buckets with the same members count once. In a bucket, pairs whose XOR
   population count is at most MAX_XOR connect; a bucket hands on a spanning forest and, for each class, one class
   that is like it, never the pairs. A large bucket is dealt to blocks twice, by two hashes.
4. Those single pairs are verified on the full sets, a class with up to a block of its partners in a task. The
   true links make components: of a group of alike copies, this settles all in work that is linear in their number.
5. What is left are classes that are alike by sketch, but in several components. Only for them all pairs across
   components count: first the sketches of large buckets whose members are not all in one component, then the exact
   intersections within each cluster of components. Members of a group's heaviest component meet only the others.
6. The components of all true links give component_id.

At similarity 0.85 a pair misses all bands with probability (1 - 0.85^ROWS)^BANDS = 7e-10, at 0.8 with 6e-7, and
the sketch filter with less than 1e-8. No cap on buckets, clusters or partners.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import apart, cut, drop, held, id_keys, map_rows, one_of_each, release
from inkwell.llm.components import connected_components

#: Words in a shingle; bands and rows of the MinHash table; bits of the odd sketch; most ones in an XOR that pass.
SHINGLE, BANDS, ROWS, BITS, MAX_XOR = 5, 36, 5, 512, 112
#: Classes in one block of a bucket; classes and shingles in one block of a cluster.
BUCKET_BLOCK, CLUSTER_BLOCK, CLUSTER_SHINGLES = 1024, 512, 400_000
#: Words whose hashes a worker remembers before it starts afresh.
CACHE_WORDS = 200_000

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class _Words(dict):
    """word -> 64-bit hash, remembered."""

    def __missing__(self, w: bytes) -> int:
        import xxhash

        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, 65)], dtype=np.uint64)


def shingle_hashes(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles.

    Words are runs of other than the six ASCII white space characters; A-Z count as a-z. A text of fewer words
    than `width` has its whole sequence as one shingle; one without words has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    known = held("words", _Words)
    if len(known) > CACHE_WORDS:
        known.clear()
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(width, len(words))
    s = np.zeros(len(words) - k + 1, dtype=np.uint64)
    for i in range(k):
        s += h[i : i + len(s)] * _POWERS[i]
    return np.unique(_mix(s + _U(k)))


def _parameters(seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    n = BANDS * ROWS
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * _U(2) + _U(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def signature(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (BANDS int64) and the odd sketch (BITS / 64 int64) of a non-empty set."""
    a, b = _parameters()
    least = np.full(BANDS * ROWS, ~_U(0))
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[at : at + 1024, None] * a + b).min(axis=0))
    least = _mix(least + np.arange(BANDS * ROWS, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
    bands = _mix((least.reshape(BANDS, ROWS) * _POWERS[:ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
    bits = np.bincount((least >> _U(40)).astype(np.int64) % BITS, minlength=BITS) & 1
    return _signed(bands), np.packbits(bits.astype(np.uint8)).view(np.int64)


def _identity(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of a set's sorted hashes."""
    import xxhash

    return struct.unpack("<qq", xxhash.xxh3_128_digest(hashes.tobytes()))


def _groups(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of a partition that is sorted by key, across batches."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        k = b[key].to_numpy()
        if held and (k[0] != held[-1][key].to_numpy()[-1]).any():
            yield pd.concat(held) if len(held) > 1 else held[0]
            held = []
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        start = 0
        for c in cuts.tolist():
            part = b.iloc[start:c]
            yield pd.concat([*held, part]) if held else part
            held, start = [], c
        held.append(b.iloc[start:])
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _forest(linked: np.ndarray) -> np.ndarray:
    """For each index the least index of its component in a symmetric boolean matrix."""
    n = len(linked)
    label = np.full(n, -1)
    for i in range(n):
        if label[i] >= 0:
            continue
        front = np.array([i])
        label[i] = i
        while len(front):
            front = np.flatnonzero(linked[front].any(axis=0) & (label < 0))
            label[front] = i
    return label


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which sketches of a and b differ in MAX_XOR bits at most."""
    ok = np.zeros((len(a), len(b)), dtype=bool)
    for at in range(0, len(a), 64):
        ok[at : at + 64] = np.bitwise_count(a[at : at + 64, None] ^ b[None]).sum(axis=2, dtype=np.int32) <= MAX_XOR
    return ok


def _sketches(g: pd.DataFrame) -> np.ndarray:
    return np.stack(g["sketch"].to_numpy()).view(np.uint64)


def _bucket_edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """u, v, w: for each class v of a bucket that is alike to others the least class u of its part of the forest and the least alike class w below it (-1: none)."""
    out: list[np.ndarray] = []
    for g in _groups(batches, ["key", "i"]):
        node = g["node"].to_numpy()
        sk = _sketches(g)
        ok = _alike(sk, sk)
        label = _forest(ok)
        first = ok.argmax(axis=1)  # the sketch of a class is alike to itself
        some = np.flatnonzero(label != np.arange(len(node)))
        out.append(np.stack([node[label[some]], node[some], np.where(first[some] < some, node[first[some]], -1)], axis=1))
        if len(out) >= 2000:
            yield pd.DataFrame(np.concatenate(out), columns=["u", "v", "w"])
            out = []
    if out:
        yield pd.DataFrame(np.concatenate(out), columns=["u", "v", "w"])
    release()


def _across(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """u, v: spanning edges between the components a of the rows and b of the columns of a matrix of links."""
    names, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = np.nonzero(linked)
    both = np.zeros((len(names), len(names)), dtype=bool)
    both[index[: len(a)][i], index[len(a) :][j]] = True
    label = _forest(both | both.T)
    some = np.flatnonzero(label != np.arange(len(names)))
    return pd.DataFrame({"u": names[some], "v": names[label[some]]})


def _cross_edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spanning edges between the components of a bucket's block, for its sketch-similar pairs of two components."""
    for g in _groups(batches, ["group", "i", "j"]):
        a, b = g[g["probe"]], g[~g["probe"]]
        if len(a) and len(b):
            ok = _alike(_sketches(a), _sketches(b)) & (a["comp"].to_numpy()[:, None] != b["comp"].to_numpy()[None])
            if ok.any():
                yield _across(ok, a["comp"].to_numpy(), b["comp"].to_numpy())
    release()


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all pairwise intersections: rare shingles by their pairs, common ones by matrix product."""
    m = len(sets)
    out = np.zeros(m * m, dtype=np.int32)
    h = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    df = np.diff(np.append(first, len(h)))
    of = np.repeat(np.arange(len(first)), df)
    rare = (df > 1) & (df <= max(8, m // 50))
    pick = np.flatnonzero(rare[of])
    o, k = owner[pick], of[pick]
    for d in range(1, int(df[rare].max()) if rare.any() else 0):
        same = k[d:] == k[:-d]
        out += np.bincount(o[:-d][same] * m + o[d:][same], minlength=m * m).astype(np.int32)
    out = out.reshape(m, m)
    out = out + out.T
    much = np.flatnonzero((df > 1) & ~rare)
    place = np.full(len(first), -1)
    place[much] = np.arange(len(much))
    pick = np.flatnonzero(place[of] >= 0)
    row, column = owner[pick], place[of[pick]]
    for at in range(0, len(much), 2048):
        here = (column >= at) & (column < at + 2048)
        x = np.zeros((m, min(2048, len(much) - at)), dtype=np.float32)
        x[row[here], column[here] - at] = 1
        out += np.rint(x @ x.T).astype(np.int32)
    return out


def _star_verifier(percent: int, width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """u, v: the true links of a class u with its partners v."""
        for g in _groups(batches, ["u", "i"]):
            hub = g["node"].to_numpy() == g["u"].to_numpy()
            if hub.all() or not hub.any():
                continue
            center = shingle_hashes(g["text"].to_numpy()[hub][0], width)
            hits = []
            for node, text in zip(g["node"].to_numpy()[~hub], g["text"].to_numpy()[~hub], strict=True):
                s = shingle_hashes(text, width)
                at = np.minimum(np.searchsorted(center, s), len(center) - 1)
                both = int((center[at] == s).sum())
                if 100 * both >= percent * (len(center) + len(s) - both):
                    hits.append(node)
            if hits:
                yield pd.DataFrame({"u": np.full(len(hits), g["u"].iloc[0]), "v": np.array(hits)})
        release()

    return run


def _cross_verifier(percent: int, width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Spanning edges between components, for the true links of a block's classes of two components."""
        for g in _groups(batches, ["group", "i", "j"]):
            probe, comp, node = g["probe"].to_numpy(), g["comp"].to_numpy(), g["node"].to_numpy()
            if not probe.any() or probe.all():
                continue
            names, first = np.unique(node, return_index=True)
            place = np.searchsorted(names, node)
            have = [shingle_hashes(t, width) for t in g["text"].to_numpy()[first]]
            size = np.array([len(s) for s in have])
            both = common_counts(have)
            linked = 100 * both >= percent * (size[:, None] + size[None] - both)
            ok = linked[np.ix_(place[probe], place[~probe])] & (comp[probe][:, None] != comp[~probe][None])
            if ok.any():
                yield _across(ok, comp[probe], comp[~probe])
        release()

    return run


def _dealt_across(rows: DataFrame) -> DataFrame:
    """Deal rows (group, node, comp, weight, ...) so that each two classes of a group that differ in comp meet in a task (group, i, j).

    A block is as many rows as weigh 1. Groups of one comp get no tasks. Of the others, all rows are dealt to blocks i and those
    of all but the heaviest comp (`probe`) to blocks j as well; a task gets a block of each.
    """
    comps = rows.groupBy("group", "comp").agg(F.sum("weight").alias("weight"))
    tops = comps.groupBy("group").agg(F.max(F.struct("weight", "comp")).alias("top"), F.sum("weight").alias("all"), F.count("*").alias("n")).where("n > 1")
    tops = tops.select("group", F.col("top.comp").alias("top"), F.ceil("all").cast("int").alias("blocks"), F.greatest(F.lit(1), F.ceil(F.col("all") - F.col("top.weight"))).cast("int").alias("probes"))
    joined = rows.join(apart(tops), "group")
    i, j = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("node", F.lit(5)), F.col("probes")).cast("int")
    tasks = F.transform(F.sequence(F.lit(0), F.col("probes") - 1), lambda x: F.struct(i.alias("i"), x.alias("j"), F.lit(False).alias("probe")))
    other = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(x.alias("i"), j.alias("j"), F.lit(True).alias("probe")))
    every = F.when(F.col("comp") == F.col("top"), tasks).otherwise(F.concat(tasks, other))
    return joined.drop("weight", "all").withColumn("t", F.explode(every)).drop("top", "blocks", "probes").select("*", "t.i", "t.j", "t.probe").drop("t")


def _tasks(df: DataFrame, *key: str) -> DataFrame:
    return df.repartition(*key).sortWithinPartitions(*key, "node")


def near_duplicates(docs: DataFrame, percent: int = 85, id_column: str = "doc_id", text_column: str = "text", width: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row.

    Two rows link if 100 * |A & B| >= percent * |A | B| on their shingle sets. component_id is the least id that
    can be reached over links, the own one included; kept says whether the row is that one. Rows without words
    link with nothing and are kept. Repeated rows share all values. A row with a null id takes its component's
    least id and is not kept; if no row of the component has an id, component_id is null and the row is kept.
    An empty table gives an empty one; other columns are ignored. percent must be 80 or more: bands and sketch
    are set for high similarities.
    """
    out = _decided(docs, percent, id_column, text_column, width)
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), component.alias("component_id"), F.when(F.col("id").isNull(), component.isNull()).otherwise(F.col("id") == component).alias("kept"))


def keep_rows(docs: DataFrame, percent: int = 85, id_column: str = "doc_id", text_column: str = "text", width: int = SHINGLE) -> DataFrame:
    """One row of each component, with its own columns: that of the least id (null last), of those the least by hash of the text; rows without words stay."""
    out = _decided(docs, percent, id_column, text_column, width).where("n > 0")
    best = out.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "h")).alias("best"))
    k1, k2 = id_keys(F.col("best.id"))
    kept = best.select(k1.alias("own_id"), k2.alias("own_null"), F.col("best.h").alias("own_hash"))
    k1, k2 = id_keys(F.col(f"`{id_column}`").cast("long"))
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    words = F.length(F.translate(text, " \t\n\x0b\x0c\r", "")) > 0
    rows = one_of_each(docs.where(words), own_id=k1, own_null=k2, own_hash=F.xxhash64(text))
    return rows.join(kept, ["own_id", "own_null", "own_hash"], "left_semi").select("row.*").unionByName(docs.where(~words))


def _decided(docs: DataFrame, percent: int, id_column: str, text_column: str, width: int) -> DataFrame:
    """id, h (of the text), n, component, component_id for each row; the last two null without words."""
    if percent < 80:
        raise ValueError("the bands and the sketch filter are set for percent >= 80")
    text = F.col(f"`{text_column}`").cast("string")
    source = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"))
    schema = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])

    def sign(b: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {f.name: [] for f in schema} | {"id": b["id"], "h": b["h"]}
        for t in b["text"]:
            s = shingle_hashes(t, width)
            (x, y), (bands, sketch) = (_identity(s), signature(s)) if len(s) else ((None, None), (None, None))
            for name, value in (("n", len(s)), ("a", x), ("b", y), ("bands", bands), ("sketch", sketch)):
                out[name].append(value)
        return out

    signed = cut(map_rows(source, {"id": "id", "h": "h", "text": "text"}, sign, schema))
    # the classes are written at once, so their numbers stay
    same = ["n", "a", "b"]
    classes = signed.where("n > 0").groupBy(*same).agg(F.min("id").alias("id"), F.min(F.struct("id", "h")).alias("one"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))

    # A band key holds its band's number, so keys of different bands do not meet.
    rows = classes.select("node", F.explode("bands").alias("key"))
    buckets = rows.groupBy("key").agg(F.count("*").alias("m"), F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(20,0)")).alias("s1"), F.min("node").alias("s2")).where("m > 1")
    buckets = buckets.groupBy("m", "s1", "s2").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("m") / BUCKET_BLOCK).cast("int").alias("parts"))
    members = cut(rows.join(buckets, "key").join(classes.select("node", "sketch"), "node"))
    block = lambda seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col("parts")).cast("int")
    twice = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.array(block(3), F.col("parts") + block(4)))
    near = cut(_tasks(members.select("key", F.explode(twice).alias("i"), "node", "sketch"), "key", "i").mapInPandas(_bucket_edges, "u bigint, v bigint, w bigint").distinct())

    # the texts of all classes that are alike to others: one row of those with the class's id and text
    some = near.select(F.explode(F.array("u", "v", "w")).alias("node")).where("node >= 0").distinct()
    (k1, k2), (o1, o2) = id_keys(F.col("id")), id_keys(F.col("one.id"))
    weight = F.greatest(F.lit(1.0 / CLUSTER_BLOCK), F.col("n") / CLUSTER_SHINGLES).alias("weight")
    wanted = classes.join(some, "node").select("node", weight, o1.alias("k1"), o2.alias("k2"), F.col("one.h").alias("h"))
    texts = source.select(k1.alias("k1"), k2.alias("k2"), "h", "text").groupBy("k1", "k2", "h").agg(F.first("text").alias("text"))
    texts = cut(texts.join(wanted, ["k1", "k2", "h"]).select("node", "weight", "text"))

    # one pair for each class
    pairs = near.where("w >= 0").groupBy("v").agg(F.min("w").alias("u")).join(texts.select(F.col("node").alias("v"), "weight"), "v")
    hubs = pairs.groupBy("u").agg(F.ceil(F.sum("weight")).cast("int").alias("parts"))
    stars = pairs.join(apart(hubs), "u").select("u", F.pmod(F.xxhash64("v", F.lit(3)), F.col("parts")).cast("int").alias("i"), F.col("v").alias("node"))
    stars = stars.unionByName(hubs.select("u", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.col("u").alias("node")))
    links = _tasks(stars.join(texts.drop("weight"), "node"), "u", "i").mapInPandas(_star_verifier(percent, width), "u bigint, v bigint")
    linked = cut(connected_components(links))

    def in_comps(df: DataFrame, *names: str) -> DataFrame:
        """df with each node replaced by its component."""
        for name in names:
            df = df.join(linked.select(F.col("node").alias(name), F.col("component").alias("_c")), name, "left").withColumn(name, F.coalesce("_c", name)).drop("_c")
        return df

    # clusters of components that may still be linked
    open_ = in_comps(near.select("u", "v"), "u", "v").where("u <> v").distinct()
    large = members.where("parts > 1").select(F.col("key").alias("group"), "node", "sketch", F.col("node").alias("comp"), F.lit(1.0 / BUCKET_BLOCK).alias("weight"))
    if not large.isEmpty():
        across = _tasks(_dealt_across(in_comps(large, "comp")), "group", "i", "j").mapInPandas(_cross_edges, "u bigint, v bigint")
        open_ = open_.unionByName(across)
    clusters = cut(connected_components(open_))
    own = in_comps(texts.select("node", "weight", F.col("node").alias("comp")), "comp")
    own = own.join(clusters.select(F.col("node").alias("comp"), F.col("component").alias("group")), "comp")
    rest = _dealt_across(own).join(texts.drop("weight"), "node")
    more = cut(_tasks(rest, "group", "i", "j").mapInPandas(_cross_verifier(percent, width), "u bigint, v bigint"))
    drop(members, near, texts)
    joined = cut(connected_components(more))

    own = in_comps(classes.select(*same, "id", F.col("node").alias("component")), "component")
    own = own.join(joined.select(F.col("node").alias("component"), F.col("component").alias("_j")), "component", "left").withColumn("component", F.coalesce("_j", "component"))
    least = apart(own.groupBy("component").agg(F.min("id").alias("component_id")))
    final = own.join(least, "component").select(*same, "component", "component_id")
    return signed.select("id", "h", *same).join(final, same, "left").drop("a", "b")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
