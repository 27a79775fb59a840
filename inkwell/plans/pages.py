"""Pages of documents through renderers, detectors and readers behind adapters: images, regions, their text, plain text.

Models are made once in each task. A document is rendered a page at a time in the task that holds its bytes, so images
don't pile up; a page that a model fails on keeps its row, with the error beside it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.operators import chunking, layout
from inkwell.plans import adapters

#: Dots an inch of page images; least confidence and image size of the detector.
DPI, CONFIDENCE, IMAGE_SIZE = 150, 0.2, 1024
#: Regions that a vision model reads, and as what; others are text, read from the page's own text where it has any.
READ_AS = {"table": "table", "figure": "figure", "isolate_formula": "formula"}
FALLBACK = {"table": "[Table could not be extracted]", "figure": "[Figure]", "formula": "[Formula could not be extracted]", "text": ""}


def rendered(documents: DataFrame, make: Callable[[], adapters.PageRenderer], dpi: int = DPI) -> DataFrame:
    """document_id, page_number (from 1), width, height, image, error of each page of documents (id, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            for i, content in zip(b["id"], b["content"], strict=True):
                try:
                    sizes = model.sizes(bytes(content or b""))
                except Exception as e:  # a broken file must not lose the others
                    yield pd.DataFrame({"document_id": [i], "page_number": [None], "width": [None], "height": [None], "image": [None], "error": [str(e)]})
                    continue
                for n, (w, h) in enumerate(sizes, 1):
                    image = error = None
                    try:
                        image = model.render(bytes(content), n, dpi)
                    except Exception as e:
                        error = str(e)
                    yield pd.DataFrame({"document_id": [i], "page_number": [n], "width": [float(w)], "height": [float(h)], "image": [image], "error": [error]})

    kind = documents.schema["id"].dataType.simpleString()
    return documents.select("id", "content").mapInPandas(run, f"document_id {kind}, page_number int, width double, height double, image binary, error string")


def detected(pages: DataFrame, make: Callable[[], adapters.LayoutDetector], confidence: float = CONFIDENCE, size: int = IMAGE_SIZE, batch: int = 8) -> DataFrame:
    """document_id, page_number, pos, bbox, label, confidence of the regions on each page's image, unfiltered; pages without an image have none."""

    @F.pandas_udf("array<struct<label:string,confidence:double,bbox:array<double>>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in parts:
            out: list = []
            for at in range(0, len(s), batch):
                some = [bytes(x) for x in s.iloc[at : at + batch]]
                out += [[{"label": r[0], "confidence": float(r[1]), "bbox": [float(x) for x in r[2:]]} for r in found] for found in model.detect(some, confidence, size)]
            yield pd.Series(out, dtype=object)

    rows = pages.where(F.col("image").isNotNull()).select("document_id", "page_number", F.posexplode(run("image")).alias("pos", "r"))
    return rows.select("document_id", "page_number", "pos", "r.bbox", "r.label", "r.confidence")


def detections(pages: DataFrame, make: Callable[[], adapters.LayoutDetector], cfg: layout.BoxConfig | None = None) -> DataFrame:
    """The regions of `detected`, filtered, with each page's counts (layout.filter_detections)."""
    return layout.filter_detections(detected(pages, make), cfg or layout.BoxConfig.service())


def regions_read(regions: DataFrame, make: Callable[[], adapters.VisionModel]) -> DataFrame:
    """regions (document_id, page_number, reading_order, label, image, own_text) with text.

    Tables, figures and formulas go to the model, and text regions without text of their own; where it fails or says
    nothing, a fixed note stands (nothing for text).
    """

    @F.pandas_udf("string")
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for label, image, own in parts:
            out = []
            for l, x, t in zip(label, image, own, strict=True):
                kind = READ_AS.get(l, "text")
                if kind == "text" and t and str(t).strip():
                    out.append(str(t).strip())
                    continue
                said = ""
                if x is not None:
                    try:
                        said = (model.read(kind, [bytes(x)]) or [""])[0] or ""
                    except Exception:  # the note stands
                        said = ""
                out.append(said.strip() or FALLBACK[kind])
            yield pd.Series(out)

    return regions.withColumn("text", run("label", "image", "own_text"))


def pages_markdown(regions: DataFrame) -> DataFrame:
    """document_id, markdown of all pages in order, from regions with text."""
    pages = chunking.page_markdown(regions)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page_number", "markdown"))), lambda x: x["markdown"])
    return pages.groupBy("document_id").agg(F.array_join(ordered, "\n\n").alias("markdown"))


def plain_text(pages: DataFrame) -> DataFrame:
    """document_id, text of pages (document_id, page_number, text): each page under a line with its number."""
    one = F.concat(F.lit("--- Page "), F.col("page_number").cast("string"), F.lit(" ---\n"), F.coalesce("text", F.lit("")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page_number", one.alias("t")))), lambda x: x["t"])
    return pages.groupBy("document_id").agg(F.array_join(ordered, "\n\n").alias("text"))
