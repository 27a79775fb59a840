"""Mixing sources to target weights by min-cost flow.

Documents that belong to the same set of sources form one membership pattern. A flow routes each pattern's tokens to
the quotas of its sources. The first, second and third copy of a pattern's tokens cost 0, 1 and 3 a token (convex, so
a copy is used up before the next begins, and overlapping sources share repetition evenly). Only those edges cost, so
the cheapest augmenting paths are those that begin with the cheapest copy: three maximal flows, one for each copy,
each on top of the one before, are the flow of least cost. Patterns that share no source, directly or by others, don't
touch each other's flow: each connected component of patterns and sources is routed in a task of its own, and
nothing comes to the driver but sums. Each pattern's flow then becomes whole copies of all its documents and one more
of those that come first in a seeded order, found with distributed prefix sums over hash buckets; the document at the
border gives only the words that are missing.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.llm.common import cut, id_keys, one_of_each
from inkwell.llm.components import connected_components

#: Most copies of a document; hash buckets of the seeded order.
MAX_COPIES, BUCKETS, SEED = 3, 4096, 7
#: Cost of a token of the first, second and third copy, rising.
COPY_COST = (0, 1, 3)
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)

WORDS = r"[^\x20\x09-\x0D]+"


class Flow:
    """A maximal flow by blocking flows (integer rooms); edges may be added between runs."""

    def __init__(self, n: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[int] = []

    def edge(self, a: int, b: int, room: int) -> int:
        """The number of the new edge; the one back is the next number."""
        k = len(self.to)
        self.to += [b, a]
        self.room += [room, 0]
        self.out[a].append(k)
        self.out[b].append(k + 1)
        return k

    def run(self, source: int, sink: int) -> None:
        while True:
            level = [-1] * len(self.out)
            level[source] = 0
            front = [source]
            while front and level[sink] < 0:
                after = []
                for a in front:
                    for k in self.out[a]:
                        if self.room[k] and level[self.to[k]] < 0:
                            level[self.to[k]] = level[a] + 1
                            after.append(self.to[k])
                front = after
            if level[sink] < 0:
                return
            at = [0] * len(self.out)
            path: list[int] = []
            here = source
            while True:
                if here == sink:
                    push = min(self.room[k] for k in path)
                    short = 0
                    for i, k in enumerate(path):
                        self.room[k] -= push
                        self.room[k ^ 1] += push
                        if not self.room[k] and not short:
                            short = i + 1
                    here = self.to[path[short - 1] ^ 1]  # go on from the first edge that is full
                    del path[short - 1 :]
                    continue
                while at[here] < len(self.out[here]):
                    k = self.out[here][at[here]]
                    if self.room[k] and level[self.to[k]] == level[here] + 1:
                        break
                    at[here] += 1
                if at[here] < len(self.out[here]):
                    path.append(self.out[here][at[here]])
                    here = self.to[path[-1]]
                elif path:
                    here = self.to[path.pop() ^ 1]
                    at[here] += 1
                else:
                    break


def route(patterns: dict[tuple, int], quotas: dict[str | None, int]) -> dict[tuple, int]:
    """The tokens that each pattern gives. patterns: sources of a pattern -> its size."""
    flow, copies = _routed(patterns, quotas)
    return {m: sum(flow.room[k ^ 1] for k in copies[m]) for m in patterns}


def _routed(patterns: dict[tuple, int], quotas: dict[str | None, int]) -> tuple[Flow, dict[tuple, list[int]]]:
    at = {s: 1 + len(patterns) + i for i, s in enumerate(quotas)}
    sink = 1 + len(patterns) + len(quotas)
    flow = Flow(sink + 1)
    for i, (members, size) in enumerate(patterns.items(), 1):
        for s in dict.fromkeys(members):
            flow.edge(i, at[s], MAX_COPIES * size)
    for s, q in quotas.items():
        flow.edge(at[s], sink, q)
    copies: dict[tuple, list[int]] = {m: [] for m in patterns}
    for _ in COPY_COST:  # in the order of their cost
        for i, (members, size) in enumerate(patterns.items(), 1):
            copies[members].append(flow.edge(0, i, size))
        flow.run(0, sink)
    return flow, copies


def _numbered(sources: DataFrame) -> DataFrame:
    """source, size, w: the sources with their weights, which repeat in code-point order, null last."""
    nulls = F.col("source").isNull()
    dealt = cut(sources.repartitionByRange(nulls, F.col("source")).withColumn("part", F.spark_partition_id()))
    counts = sorted((r["part"], r["count"]) for r in dealt.groupBy("part").count().collect())  # a row for each partition
    before, start = [], 0
    for p, n in counts:
        before.append((p, start))
        start += n
    starts = sources.sparkSession.createDataFrame(before, "part int, start long")
    n = F.row_number().over(Window.partitionBy("part").orderBy(nulls, "source")) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), (F.pmod(F.col("start") + F.col("n"), F.lit(len(WEIGHTS))) + 1).cast("int"))
    return dealt.withColumn("n", n).join(starts, "part").select("source", "size", w.alias("w"))


def targets(sources: DataFrame, total: float, most: int = MAX_COPIES) -> DataFrame:
    """source, size, target: the share of `total` by weight, at most `most` times the size; the excess is shared again by weight until none is above."""
    numbered = cut(_numbered(sources))
    level, before = 0.0, -1
    while True:  # each round fixes more sources at their most, so there are few
        over = F.lit(level) * F.col("w") > most * F.col("size") if before >= 0 else F.lit(False)
        r = numbered.agg(F.coalesce(F.sum(F.when(over, most * F.col("size"))), F.lit(0)).alias("fixed"), F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0.0)).alias("w"), F.count(F.when(over, 1)).alias("n")).first()
        if r["n"] == before:
            break
        before = r["n"]
        if not r["w"]:
            break
        level = (total - r["fixed"]) / r["w"]
    return numbered.select("source", "size", F.least(F.lit(level) * F.col("w"), (most * F.col("size")).cast("double")).alias("target"))


def mix(docs: DataFrame, memberships: str | None = None, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", seed: int = SEED) -> DataFrame:
    """The id, size, source_size, target, taken and text_hash of each row of docs.

    size: runs of other than ASCII white space in the text (null: 0). Each document belongs to its source (null
    is a source of its own, the last) or, with `memberships`, to the sources in that array column (the values
    source_size and target are then those of its first source in code-point order; no source: nothing is taken).
    taken: words the mix takes, at most 3 times the size. Repeated rows count each; a null id is allowed; empty
    texts take 0; an empty table gives an empty one. The seeded order depends on id and text only, so reruns agree.
    """
    source = F.col(f"`{source_column}`").cast("string") if memberships is None else None
    pattern = F.array(source) if memberships is None else F.array_sort(F.array_distinct(F.coalesce(F.col(f"`{memberships}`").cast("array<string>"), F.array().cast("array<string>"))))
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    size = F.regexp_count(text, F.lit(WORDS)).cast("long")
    sized = cut(docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), pattern.alias("pattern"), size.alias("size"), F.xxhash64(text).alias("text_hash")))
    return _mixed(sized, seed).withColumnRenamed("id", id_column)


def _given(patterns: DataFrame, shares: DataFrame) -> DataFrame:
    """pattern, size, given: what the flow takes of each pattern, routed a connected component at a time."""
    members = patterns.select("pattern", "size", F.explode_outer("pattern").alias("source")).where(F.size("pattern") > 0)
    # hashes may coincide: two components in one task do no harm
    node, source = F.xxhash64("pattern", F.lit(1)), F.xxhash64("source", F.lit(2))
    if patterns.where(F.size("pattern") > 1).isEmpty():  # a component is a source
        left = patterns.where(F.size("pattern") > 0).select(F.xxhash64(F.get("pattern", F.lit(0)), F.lit(2)).alias("component"), "pattern", "size")
        right = shares.select(source.alias("of"), "source", "target")
    else:
        parts = cut(connected_components(members.select(node.alias("u"), source.alias("v"))))
        left = patterns.where(F.size("pattern") > 0).withColumn("node", node).join(parts, "node").select("component", "pattern", "size")
        right = shares.withColumn("node", source).join(parts, "node").select(F.col("component").alias("of"), "source", "target")

    def run(own: pd.DataFrame, quotas: pd.DataFrame) -> pd.DataFrame:
        own, quotas = own.sort_values("size", kind="stable"), quotas.sort_values("source", kind="stable", na_position="last")
        name = lambda s: None if s is None or s != s else s
        sizes = dict(sorted(((tuple(map(name, p)), int(n)) for p, n in zip(own["pattern"], own["size"], strict=True)), key=lambda x: [(s is None, s or "") for s in x[0]]))
        given = route(sizes, {name(s): round(t) for s, t in zip(quotas["source"], quotas["target"], strict=True)})
        return pd.DataFrame({"pattern": [list(m) for m in sizes], "size": list(sizes.values()), "given": [given[m] for m in sizes]}, columns=["pattern", "size", "given"])

    routed = left.groupBy("component").cogroup(right.groupBy("of")).applyInPandas(run, "pattern array<string>, size long, given long")
    none = patterns.where(F.size("pattern") == 0).select("pattern", "size", F.lit(0).cast("long").alias("given"))
    return cut(routed.unionByName(none))


def _mixed(sized: DataFrame, seed: int) -> DataFrame:
    patterns = cut(sized.groupBy("pattern").agg(F.sum("size").alias("size")))
    sources = patterns.select(F.explode("pattern").alias("source"), "size").groupBy("source").agg(F.sum("size").alias("size"))
    # of overlapping sources, all tokens are shared out, each counted once; at most `most` times their part of them
    whole = patterns.where(F.size("pattern") > 0).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("once"), F.coalesce(F.sum(F.col("size") * F.size("pattern")), F.lit(0)).alias("each")).first()
    scale = whole["once"] / max(1, whole["each"])
    shares = cut(targets(sources, float(whole["each"])).withColumn("target", F.col("target") * F.lit(float(scale)) if scale != 1 else F.col("target")))

    given = _given(patterns, shares)
    first = shares.select(F.col("source").alias("_source"), F.col("size").alias("source_size"), "target")
    plan = given.withColumn("_first", F.get("pattern", F.lit(0))).join(first, (F.size("pattern") > 0) & F.col("_first").eqNullSafe(F.col("_source")), "left")
    some = F.greatest(F.col("size"), F.lit(1))
    plan = plan.select("pattern", F.floor(F.col("given") / some).alias("copies"), F.pmod("given", some).alias("rest"), F.coalesce("source_size", F.lit(0)).alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"))

    marked = sized.withColumn("h", F.xxhash64(F.coalesce("id", F.lit(-1)), "text_hash", F.lit(seed))).withColumn("bucket", F.pmod(F.col("h"), F.lit(BUCKETS)).cast("int"))
    sums = marked.groupBy("pattern", "bucket").agg(F.sum("size").alias("bucket_size"))
    starts = sums.withColumn("start", F.sum("bucket_size").over(Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("pattern", "bucket", F.coalesce("start", F.lit(0)).alias("start"))
    # pattern and plan meet here, at most BUCKETS rows of a pattern, so that a hot source's documents never share a task
    starts = starts.join(plan, "pattern")
    within = Window.partitionBy("pattern", "bucket").orderBy("h", "id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    done = marked.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, ["pattern", "bucket"])
    extra = F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("start") - F.col("ahead")))
    return done.select("id", "size", "source_size", "target", (F.col("copies") * F.col("size") + extra).cast("long").alias("taken"), "text_hash")


def repeat_rows(docs: DataFrame, mixed: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each row of docs, with its own columns, as often as `mixed` takes it, to the nearest whole copy; of rows of one id and text the takings are one sum."""
    k1, k2 = id_keys(F.col(id_column))
    taken = mixed.groupBy(k1.alias("own_id"), k2.alias("own_null"), F.col("text_hash").alias("own_hash")).agg(F.max("size").alias("size"), F.sum("taken").alias("taken")).where("taken > 0")
    taken = taken.select("own_id", "own_null", "own_hash", F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("times")).where("times > 0")
    k1, k2 = id_keys(F.col(f"`{id_column}`").cast("long"))
    rows = one_of_each(docs, own_id=k1, own_null=k2, own_hash=F.xxhash64(F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))))
    rows = rows.join(taken, ["own_id", "own_null", "own_hash"])
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the targets of their sources."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
