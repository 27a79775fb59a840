"""Text segmentation: paragraph packing, row batches, markdown trees, sentences; one text in, a list of pieces out.

The pieces of a text depend on a running length, so they come from an Arrow UDF over batches of texts; ids,
links, contexts and order are columns and windows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions import text as T
from inkwell.functions import vectors as V

CHUNK_SIZE, MAX_CHUNK = 1500, 2500
ROWS_PER_CHUNK = 50


def pack(parts: list[str], size: int, glue: str, counted: int) -> list[str]:
    """Join parts greedily: a part is added while the joined length and `counted` more characters stay within size."""
    out: list[list[str]] = []
    length = 0
    for p in parts:
        if out and length + len(p) + counted <= size:
            out[-1].append(p)
        else:
            out.append([p])
            length = 0
        length += len(p) + len(glue)
    return [glue.join(x) for x in out]


def split_sentences_packed(paragraph: str, size: int) -> list[str]:
    """The sentences of a long paragraph, packed. A bar also separates and is lost; a longer sentence stays whole."""
    parts = re.split(r"(?<=[.?!]) |\|", paragraph)
    return pack([p.strip() for p in parts if p.strip()], size, " ", 0)


def split_text(text: str, size: int = CHUNK_SIZE) -> list[str]:
    """Paragraphs packed to `size`; longer ones by sentences, on their own."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        out.extend(pack(run, size, "\n\n", 0))
        run.clear()

    for p in filter(None, map(str.strip, text.split("\n\n"))):
        if len(p) > size:
            flush()
            out.extend(split_sentences_packed(p, size))
        else:
            run.append(p)
    flush()
    return out


def split_content(content: str, size: int = MAX_CHUNK) -> list[str]:
    """Content over `size` by blank lines, then by sentences; the last sentences of a long paragraph may go on with the next one."""
    if len(content) <= size:
        return [content]
    out: list[str] = []
    held = ""
    for para in re.split(r"\n\n+", content):
        if len(held) + len(para) + 2 <= size:
            held = f"{held}\n\n{para}" if held else para
            continue
        if held:
            out.append(held)
        held = para
        if len(para) > size:
            *done, held = _by_sentences(para, size)
            out += done
    return out + [held] if held else out


def _by_sentences(para: str, size: int) -> list[str]:
    return pack(re.split(r"(?<=[.!?])\s+", para), size, " ", 0)


_FENCE, _HEADING, _ITEM = "```", re.compile(r"(#{1,6})\s+(.+)$"), re.compile(r"\s*(?:[-*+]|\d+\.)\s+")


def is_list(content: str) -> bool:
    lines = [x for x in content.strip().split("\n") if x.strip()]
    return sum(bool(_ITEM.match(x)) for x in lines) * 2 > len(lines)


def markdown_blocks(markdown: str) -> list[tuple[int, str, str]]:
    """(level, kind, text) of headings (level 1 to 6) and content (level 0), in order. Kinds: heading, paragraph, table, list, figure, code."""
    out: list[tuple[int, str, str]] = []
    held: list[str] = []
    fenced = table = False

    def flush(kind: str = "paragraph") -> None:
        text = "\n".join(held).strip()
        held.clear()
        if text:
            kind = "figure" if "![" in text or "<img" in text.lower() else kind
            out.append((0, "code" if text.startswith(_FENCE) else kind, text))

    for line in markdown.split("\n"):
        bare = line.strip()
        if bare.startswith(_FENCE) or fenced:
            fenced ^= bare.startswith(_FENCE)
            held.append(line)
            continue
        if bare.startswith("|") and not table:
            flush()
            table = True
        if table:
            if bare.startswith("|") or not bare:
                held.append(line)
                continue
            flush("table")
            table = False
        heading = _HEADING.match(line)
        if heading:
            flush()
            out.append((len(heading[1]), "heading", heading[2].strip()))
            continue
        if _ITEM.match(line) and held and not is_list("\n".join(held)):
            flush()
        held.append(line)
    flush("table" if table else "list" if is_list("\n".join(held)) else "paragraph")
    return out


def markdown_chunks(markdown: str, size: int = MAX_CHUNK) -> list[tuple[str, str, int, str | None, int]]:
    """(text, content type, level, heading path, index of the parent chunk or -1) in reading order.

    A heading is a chunk if anything stands under it; content hangs on the nearest heading chunk above.
    """
    blocks = markdown_blocks(markdown)
    out: list[tuple[str, str, int, str | None, int]] = []
    path: list[tuple[int, str, int]] = []  # level, heading, its chunk
    for k, (level, kind, text) in enumerate(blocks):
        if level:
            while path and path[-1][0] >= level:
                path.pop()
            parent = next((c for _, _, c in reversed(path) if c >= 0), -1)
            below = blocks[k + 1][0] if k + 1 < len(blocks) else 1
            under = k + 1 < len(blocks) and (below == 0 or below > level)
            path.append((level, text, len(out) if under else -1))
            if under:
                out.append((text, "title" if level == 1 else "section_header", level, " > ".join(p[1] for p in path), parent))
        else:
            parent = next((c for _, _, c in reversed(path) if c >= 0), -1)
            kind = kind if kind in ("table", "list", "figure") else "paragraph"
            where = " > ".join(p[1] for p in path) or None
            out += [(t, kind, (path[-1][0] if path else 0) + 1, where, parent) for t in split_content(text, size)]
    return out


_BREAK = re.compile(r"(?<=[.!?])\s+(?=[A-Z])|(?<=[.!?])\s*\n+")


def sentences(text: str) -> list[tuple[str, int, int]]:
    """(sentence, start, end) of sentences over ten characters; the break's first character still belongs to the span."""
    out, start = [], 0
    for m in [*_BREAK.finditer(text), None]:
        end = len(text) if m is None else m.start() + 1
        if start < len(text) or m:
            s = text[start:end].strip()
            if len(s) > 10:
                out.append((s, start, end))
        start = len(text) if m is None else m.end()
    return out


def split_at(text: str, breaks: list[int], least: int = 50) -> list[str]:
    """The pieces between breakpoints of 50 characters or more; the text itself if there are none."""
    edges = [0, *breaks, len(text)]
    parts = [text[a:z].strip() for a, z in zip(edges, edges[1:], strict=False)]
    return [p for p in parts if len(p) >= least] or [text]


def exploded(df: DataFrame, column: str, fn: Callable[[str], list], element: str) -> DataFrame:
    """df with a row for each piece of a text column: piece_index, piece. Null texts have none."""

    @F.pandas_udf(f"array<{element}>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [] if t is None else fn(t))

    return df.select("*", F.posexplode(run(F.col(column))).alias("piece_index", "piece"))


def paragraph_chunks(docs: DataFrame, size: int = CHUNK_SIZE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """document_id, chunk_index, chunk_id, text of each packed piece."""
    rows = exploded(docs.select(F.col(id_column).alias("document_id"), F.col(text_column).alias("_text")), "_text", lambda t: split_text(t, size), "string")
    return rows.select("document_id", F.col("piece_index").alias("chunk_index"), T.short_id(F.col("document_id"), F.col("piece_index")).alias("chunk_id"), F.col("piece").alias("text"))


def hierarchical_chunks(docs: DataFrame, size: int = MAX_CHUNK, id_column: str = "doc_id", text_column: str = "markdown") -> DataFrame:
    """document_id, chunk_index, chunk_id, text, content_type, hierarchy_level, heading_path, parent_chunk_id."""
    element = "struct<text:string,content_type:string,level:int,heading_path:string,parent:int>"
    fields = ("text", "content_type", "level", "heading_path", "parent")
    rows = exploded(docs.select(F.col(id_column).alias("document_id"), F.col(text_column).alias("_text")), "_text", lambda t: [dict(zip(fields, c, strict=True)) for c in markdown_chunks(t, size)], element)
    own = T.short_id(F.col("document_id"), F.col("piece_index"))
    parent = F.when(F.col("piece.parent") >= 0, T.short_id(F.col("document_id"), F.col("piece.parent")))
    return rows.select("document_id", F.col("piece_index").alias("chunk_index"), own.alias("chunk_id"), "piece.text", "piece.content_type", F.col("piece.level").alias("hierarchy_level"), "piece.heading_path", parent.alias("parent_chunk_id"))


def linked(chunks: DataFrame) -> DataFrame:
    """Chunks with the ids of their neighbours in the document."""
    w = Window.partitionBy("document_id").orderBy("chunk_index")
    return chunks.withColumn("prev_chunk_id", F.lag("chunk_id").over(w)).withColumn("next_chunk_id", F.lead("chunk_id").over(w))


def boundaries(chunks: DataFrame, threshold: float = 0.72) -> DataFrame:
    """Chunks (document_id, chunk_index, vector) with their similarity to the one before and whether it is below the threshold."""
    w = Window.partitionBy("document_id").orderBy("chunk_index")
    sim = V.dot(F.lag("vector").over(w), F.col("vector"))
    return chunks.withColumn("semantic_similarity_prev", sim).withColumn("is_semantic_boundary", F.coalesce(sim < threshold, F.lit(False)))


def breakpoints(parts: DataFrame, threshold: float = 0.72) -> DataFrame:
    """Of sentences (id, n, end, vector), the ends after which the next one is unlike; texts under three sentences have none."""
    w = Window.partitionBy("id").orderBy("n")
    rows = parts.withColumn("next", F.lead("vector").over(w)).withColumn("total", F.count("*").over(Window.partitionBy("id")))
    return rows.where((F.col("total") >= 3) & (V.dot(F.col("vector"), F.col("next")) < threshold)).groupBy("id").agg(F.array_sort(F.collect_list("end")).alias("breaks"))


def numbered(rows: DataFrame, document: str, order: list[str], per_batch: int = ROWS_PER_CHUNK) -> DataFrame:
    """rows with chunk_index, from 0 within each document, and the batch of `per_batch` that it falls in."""
    n = F.row_number().over(Window.partitionBy(document).orderBy(*order)) - 1
    return rows.withColumn("chunk_index", n).withColumn("batch", F.floor(F.col("chunk_index") / per_batch).cast("int"))


#: Ranges that a table without groups is numbered in, and about how many rows' keys give their bounds.
RANGES, RANGE_KEYS = 200, 4000


def row_numbers(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their number from 1 in the order of some columns over the whole table, which no single task sorts.

    The keys of some rows, chosen by hash, bound RANGES ranges; numbers are a range's own beside the count of those before.
    """
    key = F.struct(*order)
    every = max(1, rows.count() // RANGE_KEYS)
    some = rows.where(F.pmod(F.xxhash64(*order), F.lit(every)) == 0).select(*order).distinct().orderBy(*order).limit(2 * RANGE_KEYS)
    got = some.withColumn("_i", F.row_number().over(Window.orderBy(*order))).where(F.col("_i") % max(1, 2 * RANGE_KEYS // RANGES) == 0).drop("_i")
    bounds = got.agg(F.array_sort(F.collect_list(F.struct(*order))).alias("_bounds"))  # one row of RANGES keys at most
    dealt = rows.crossJoin(F.broadcast(bounds)).withColumn("_range", F.size(F.filter("_bounds", lambda b: b <= key))).drop("_bounds")
    counts = dealt.groupBy("_range").count()
    before = counts.select("_range", F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn(name, own).join(F.broadcast(before), "_range").withColumn(name, (F.col(name) + F.col("_before")).cast("int")).drop("_range", "_before")


def row_text(columns: list[str], number: Column) -> Column:
    """`Row n: a=1, b=2`, null cells left out."""
    cells = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in columns]
    return F.concat(F.lit("Row "), number.cast("string"), F.lit(": "), F.concat_ws(", ", *cells))


def row_batches(rows: DataFrame, columns: list[str], order: list[str], group: str | None = None, per_chunk: int = ROWS_PER_CHUNK, size: int = CHUNK_SIZE) -> DataFrame:
    """Tabular rows as chunks of `per_chunk` rows with a header line; longer than twice `size`, a batch is cut at rows and the header repeated.

    Rows are numbered from 1 within `group` (a file or sheet; without one, the whole table is one file).
    """
    keys = [group] if group else []
    every = rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))) if group else row_numbers(rows, order, "_n")
    every = every.withColumn("_batch", F.floor((F.col("_n") - 1) / per_chunk).cast("int"))
    lines = every.select(*keys, "_batch", "_n", row_text(columns, F.col("_n")).alias("_line"))
    lists = lines.groupBy(*keys, "_batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_line"))), lambda x: x["_line"]).alias("_lines"))
    header = "Columns: " + ", ".join(columns)

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        def one(ls: list[str]) -> list[str]:
            whole = "\n".join([header, *ls])
            return [whole] if len(whole) <= 2 * size else [f"{header}\n{x}" for x in pack(list(ls), 2 * size - len(header), "\n", 1)]

        return s.map(one)

    return lists.select(*keys, F.col("_batch").alias("batch"), F.posexplode(run("_lines")).alias("part", "text"))


def table_text(title: Column, headers: Column, rows: Column, most: int = 5, cell: int = 50) -> Column:
    """A small table as lines: title, headers, the first rows with cells cut, and how many more there are."""
    line = lambda r: F.array_join(F.transform(r, lambda c: F.substring(c, 1, cell)), " | ")
    more = F.when(F.size(rows) > most, F.concat(F.lit("... and "), (F.size(rows) - most).cast("string"), F.lit(" more rows")))
    return F.concat_ws("\n", title, F.array_join(headers, " | "), F.array_join(F.transform(F.slice(rows, 1, most), line), "\n"), more)


#: Region labels of a page and how their text is written.
REGION_MARKS = {"title": "# {}", "section-header": "## {}", "isolate_formula": "$$\n{}\n$$", "figure_caption": "*{}*", "table_caption": "*{}*", "formula_caption": "*{}*", "table_footnote": "[^]: {}"}
REGION_SKIPPED = ("abandon", "page-header", "page-footer")


def region_markdown(label: Column, text: Column) -> Column:
    """A region's text as markdown; null for what is skipped."""
    one_line = F.trim(F.regexp_replace(text, r"\s+", " "))
    out = F.when(label.isin(*REGION_SKIPPED), F.lit(None).cast("string"))
    for k, form in REGION_MARKS.items():
        before, after = form.split("{}")
        out = out.when(label == k, F.concat(F.lit(before), one_line if k in ("title", "section-header") else text, F.lit(after)))
    return out.otherwise(text)


def page_markdown(regions: DataFrame) -> DataFrame:
    """document_id, page_number, markdown from regions (document_id, page_number, reading_order, label, text)."""
    rows = regions.withColumn("_md", region_markdown(F.col("label"), F.col("text"))).where(F.col("_md").isNotNull() & (F.trim("_md") != ""))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "_md"))), lambda x: x["_md"])
    return rows.groupBy("document_id", "page_number").agg(F.array_join(ordered, "\n\n").alias("markdown"))
