"""The document store on Parquet: upserts, column updates and cascading deletes as joins; every call returns new frames.

A write makes a new numbered snapshot beside the old ones and then a marker file for it, in one step of the file system;
a snapshot without marker does not count. Readers see the old or the new one whenever a writer stops, and a reader at
work keeps its files, as the snapshot before stays. Of two writers at once the second fails.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.operators import bm25
from inkwell.session import plain_unions

#: child table -> (parent table, key in the child); ids are `id`, or what `KEYS` says.
PARENTS = {"chunks": ("documents", "document_id"), "pages": ("documents", "document_id"), "chunk_metadata": ("chunks", "chunk_id"), "chunk_questions": ("chunks", "chunk_id"), "vectors": ("chunks", "chunk_id")}
KEYS = {"documents": "id", "chunks": "id"}

SCHEMAS = {
    "documents": "id string, file_path string, file_name string, file_type string, file_hash string, detected_doc_type string, summary string, entities map<string,string>, key_topics array<string>, table_descriptions array<string>, indexed_at timestamp_ntz, sheet_names array<string>, column_schema map<string,string>, row_count int, date_range string, processing_status string, layout_data string, extracted_markdown string, reviewed_markdown string, page_count int",
    "chunks": "id string, document_id string, text string, contextualized_text string, content_type string, page int, sheet_name string, heading_path string, entities map<string,string>, chunk_index int, parent_chunk_id string, hierarchy_level int, bbox array<double>, layout_label string, is_semantic_boundary boolean, semantic_similarity_prev double",
    "chunk_metadata": "chunk_id string, title string, summary string, keywords array<string>, entities map<string,array<string>>, category string, contextual_description string, temporal_context string, enriched_at timestamp_ntz",
    "chunk_questions": "id string, chunk_id string, question string, vector_id string",
    "vectors": "vector_id string, chunk_id string, vector_type string, source_text string, embedding array<float>",
    "pages": "id string, document_id string, page_number int, image_path string, layout string, unfiltered_layout string, filter_stats string, extracted_text string",
}


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `new` replace those of the same key; columns that `new` lacks keep their old value (null for new keys)."""
    keys = list(keys)
    missing = [c for c in old.columns if c not in new.columns]
    if missing:
        new = new.join(old.select(*keys, *missing), keys, "left")
    plain_unions(old.sparkSession)
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*old.columns))


def replace_children(old: DataFrame, new: DataFrame, parent_key: str) -> DataFrame:
    """The rows of each parent in `new` replace all its old rows; parents without new rows keep theirs."""
    plain_unions(old.sparkSession)
    return old.join(new.select(parent_key).distinct(), parent_key, "left_anti").unionByName(new)


def update(old: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Set the columns of `changes` where its value is not null; keys without a row do nothing."""
    keys = list(keys)
    names = [c for c in changes.columns if c not in keys]
    renamed = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in names])
    joined = old.join(renamed, keys, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in names else F.col(c) for c in old.columns])


def delete(tables: dict[str, DataFrame], table: str, gone: DataFrame) -> dict[str, DataFrame]:
    """Delete rows of a table by their `id` in `gone` and, as anti-joins, what hangs on them; chunks of which a parent chunk goes lose the pointer."""
    out = dict(tables)
    ids = {table: gone.select("id").distinct()}
    out[table] = tables[table].join(ids[table], "id", "left_anti")
    for child, (parent, key) in PARENTS.items():
        if child in tables and parent in ids:
            hit = F.col(key) == F.col("_gone")
            dead = ids[parent].select(F.col("id").alias("_gone"))
            if child in KEYS:
                ids[child] = tables[child].join(dead, hit, "left_semi").select("id")
            out[child] = tables[child].join(dead, hit, "left_anti")
    if "chunks" in ids and "parent_chunk_id" in out["chunks"].columns:
        dead = ids["chunks"].select(F.col("id").alias("_gone"))
        joined = out["chunks"].join(dead, F.col("parent_chunk_id") == F.col("_gone"), "left")
        out["chunks"] = joined.withColumn("parent_chunk_id", F.when(F.col("_gone").isNull(), F.col("parent_chunk_id"))).drop("_gone")
    return out


def delete_folder(tables: dict[str, DataFrame], path: str) -> dict[str, DataFrame]:
    """All documents under a folder, in one go."""
    return delete(tables, "documents", tables["documents"].where(F.col("file_path").startswith(path.rstrip("/") + "/")))


def changed_files(found: DataFrame, known: DataFrame) -> DataFrame:
    """Files (id, file_hash) that are new or whose content hash differs: what an incremental index must read."""
    return found.join(known.select("id", "file_hash"), ["id", "file_hash"], "left_anti")


def removed_files(found: DataFrame, known: DataFrame) -> DataFrame:
    return known.join(found.select("id"), "id", "left_anti")


def with_details(chunks: DataFrame, metadata: DataFrame, questions: DataFrame) -> DataFrame:
    """Chunks with their metadata and the list of their questions."""
    asked = questions.groupBy("chunk_id").agg(F.array_sort(F.collect_list("question")).alias("questions"))
    key = F.col("id") == F.col("chunk_id")
    return chunks.join(metadata.drop("entities"), key, "left").drop("chunk_id").join(asked, key, "left").drop("chunk_id")


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])


class Store:
    """Tables as Parquet snapshots under one folder of any file system that Spark reaches."""

    #: Snapshots of a table that stay.
    KEPT = 2

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, table: str) -> list[str]:
        where = self._path(f"{self.path}/{table}")
        return [x.getPath().getName() for x in self._fs.listStatus(where)] if self._fs.exists(where) else []

    def versions(self, table: str) -> list[int]:
        """The committed snapshots of a table, oldest first."""
        names = set(self._names(table))
        return sorted(int(n[:-5]) for n in names if n.endswith(".done") and n[:-5] in names)

    def read(self, table: str) -> DataFrame:
        found = self.versions(table)
        return self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.path}/{table}/{found[-1]:012d}") if found else empty(self.spark, table)

    def write(self, table: str, df: DataFrame) -> None:
        """Write a snapshot, then commit it by its marker; older ones but KEPT go, and what a stopped writer left."""
        before = self.versions(table)
        version = max([int(n[:12]) for n in self._names(table) if n[:12].isdigit()], default=0) + 1
        where = f"{self.path}/{table}/{version:012d}"
        out = df.select(*[f.name for f in empty(self.spark, table).schema])
        writer = out.write.mode("errorifexists")
        (writer.partitionBy("vector_type") if table == "vectors" else writer).parquet(where)
        self._commit(where)
        stay = {f"{v:012d}" for v in [*before, version][-self.KEPT :]}
        for name in self._names(table):
            if name[:12].isdigit() and int(name[:12]) < version and name[:12] not in stay:
                self._fs.delete(self._path(f"{self.path}/{table}/{name}"), True)

    def _commit(self, where: str) -> None:
        self._fs.create(self._path(f"{where}.done"), False).close()  # fails if another writer was first

    def upsert(self, table: str, rows: DataFrame, keys: Sequence[str] = ("id",)) -> None:
        self.write(table, upsert(self.read(table), rows, keys))

    def clear(self) -> None:
        for table in SCHEMAS:
            self.write(table, empty(self.spark, table))

    def find(self, table: str, condition: Column) -> DataFrame:
        return self.read(table).where(condition)

    def write_index(self, index: bm25.Index) -> None:
        """A new snapshot of the keyword index: postings, lengths and terms."""
        before = self.versions("keywords")
        version = max([int(n[:12]) for n in self._names("keywords") if n[:12].isdigit()], default=0) + 1
        where = f"{self.path}/keywords/{version:012d}"
        bm25.write(index, where)
        self._commit(where)
        for v in before[: -self.KEPT + 1]:
            for name in (f"{v:012d}.done", f"{v:012d}"):
                self._fs.delete(self._path(f"{self.path}/keywords/{name}"), True)

    def read_index(self) -> bm25.Index | None:
        """The keyword index last written; None without one."""
        found = self.versions("keywords")
        return bm25.read(self.spark, f"{self.path}/keywords/{found[-1]:012d}") if found else None


def processing_status(documents: DataFrame) -> DataFrame:
    """id, processing_status, page_count, has_layout, has_markdown of each document."""
    return documents.select("id", "processing_status", "page_count", F.col("layout_data").isNotNull().alias("has_layout"), F.col("extracted_markdown").isNotNull().alias("has_markdown"))


def page_info(pages: DataFrame) -> DataFrame:
    """document_id, page_number, n_detections, n_unfiltered, n_removed (never below 0) from the JSON lists of a page's boxes; text that is no list counts as none."""
    count = lambda c: F.coalesce(F.json_array_length(c), F.lit(0))
    n, every = count("layout"), count("unfiltered_layout")
    return pages.select("document_id", "page_number", n.alias("n_detections"), every.alias("n_unfiltered"), F.greatest(F.lit(0), every - n).alias("n_removed"))


def layout_boxes(documents: DataFrame) -> DataFrame:
    """id, page_number, pos, label, text, bbox of a document's layout_data: a flat JSON list of boxes, or one of pages with their `regions`."""
    box = "struct<label:string,text:string,bbox:array<double>,page:int>"
    raw = F.from_json("layout_data", f"array<struct<label:string,text:string,bbox:array<double>,page:int,page_number:int,regions:array<{box}>>>")
    rows = documents.select("id", F.posexplode(raw).alias("i", "x"))
    flat = F.array(F.struct(F.lit(0).alias("j"), F.coalesce("x.page", "x.page_number").alias("page"), F.col("x.label").alias("label"), F.col("x.text").alias("text"), F.col("x.bbox").alias("bbox")))
    page = F.coalesce("x.page_number", "x.page", F.col("i") + 1)
    nested = F.transform("x.regions", lambda r, j: F.struct(j.alias("j"), F.coalesce(page, r["page"]).alias("page"), r["label"].alias("label"), r["text"].alias("text"), r["bbox"].alias("bbox")))
    every = rows.select("id", "i", F.explode(F.when(F.col("x.regions").isNotNull(), nested).otherwise(flat)).alias("b")).where(F.col("b.label").isNotNull() | F.col("b.bbox").isNotNull())
    pos = F.row_number().over(Window.partitionBy("id").orderBy("i", "b.j")) - 1
    return every.select("id", F.col("b.page").alias("page_number"), pos.alias("pos"), "b.label", "b.text", "b.bbox")


def matched_boxes(nodes: DataFrame, boxes: DataFrame, shown: int = 100) -> DataFrame:
    """nodes (id, node, text) with label and bbox of the first box (by pos) of their document whose text holds the node's first characters; null where none does."""
    start = F.lower(F.trim(F.substring("text", 1, shown)))
    wanted = nodes.select("id", "node", start.alias("_start")).where(F.length("_start") > 0)
    hits = wanted.join(boxes.select("id", "pos", F.lower("text").alias("_text"), "label", "bbox"), "id").where(F.instr(F.col("_text"), F.col("_start")) > 0)
    first = hits.groupBy("id", "node").agg(F.min_by(F.struct("label", "bbox"), "pos").alias("_b")).select("id", "node", "_b.label", "_b.bbox")
    return nodes.join(first, ["id", "node"], "left")


def reindex(found: DataFrame, known: DataFrame, failed: DataFrame) -> DataFrame:
    """outcome, n of a reindexing of files (id, file_hash): processed, failed (ids in `failed`), skipped (unchanged) and removed."""
    todo = changed_files(found, known)
    bad = todo.join(failed.select("id").distinct(), "id", "left_semi")
    parts = {"processed": todo.join(failed.select("id").distinct(), "id", "left_anti"), "failed": bad, "skipped": found.join(known.select("id", "file_hash"), ["id", "file_hash"], "left_semi"), "removed": removed_files(found, known)}
    rows = [df.select(F.lit(name).alias("outcome")) for name, df in parts.items()]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
    return every.groupBy("outcome").agg(F.count("*").alias("n"))
