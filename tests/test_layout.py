"""Box filtering and reading order on hand-made pages."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell.functions import geometry as G
from inkwell.operators import layout as L

GEOMETRY = [  # a, b, area of a, intersection, iou, share of a in b
    ([0, 0, 10, 10], [20, 20, 30, 30], 100, 0, 0, 0),
    ([5, 5, 15, 25], [0, 0, 10, 10], 200, 25, 25 / 275, 0.125),
    ([0, 0, 0, 0], [0, 0, 10, 10], 0, 0, 0, 0),
    ([10, 10, 0, 0], [0, 0, 10, 10], 0, 0, 0, 0),
    ([0, 0, 10, 10], [5, 5, 15, 15], 100, 25, 1 / 7, 0.25),
    ([5, 5, 15, 15], [0, 0, 20, 20], 100, 100, 0.25, 1),
    ([0, 0, 10, 10], [0, 0, 10, 10], 100, 100, 1, 1),
    ([2, 2, 8, 8], [0, 0, 10, 10], 36, 36, 0.36, 1),
]


def test_geometry(spark):
    df = spark.createDataFrame([([float(x) for x in a], [float(x) for x in b]) for a, b, *_ in GEOMETRY], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got = df.select(G.area(a), G.intersection(a, b), G.iou(a, b), G.containment(a, b)).collect()
    for g, (_, _, *want) in zip(got, GEOMETRY, strict=True):
        assert list(g) == pytest.approx(want)


CASES = {  # boxes (label, box, confidence), settings, indices kept
    "text in table": ([("table", [0, 0, 100, 100], 0.9), ("text", [10, 10, 90, 90], 0.8)], {}, [0]),
    "text in figure": ([("figure", [0, 0, 100, 100], 0.9), ("plain text", [10, 10, 90, 90], 0.8)], {}, [0]),
    "caption in figure": ([("figure", [0, 0, 100, 100], 0.9), ("figure_caption", [10, 80, 90, 95], 0.8)], {}, [0, 1]),
    "caption in table": ([("table", [0, 0, 100, 100], 0.9), ("table_caption", [10, 5, 90, 15], 0.8)], {}, [0, 1]),
    "footnote in table": ([("table", [0, 0, 100, 100], 0.9), ("table_footnote", [10, 85, 90, 98], 0.8)], {}, [0, 1]),
    "disjoint": ([("text", [0, 0, 50, 50], 0.9), ("text", [60, 60, 100, 100], 0.8)], {}, [0, 1]),
    "same label": ([("text", [0, 0, 50, 50], 0.9), ("text", [10, 10, 60, 60], 0.7)], {"iou": 0.3}, [0]),
    "across labels": ([("table", [0, 0, 50, 50], 0.9), ("text", [5, 5, 55, 55], 0.95)], {"iou": 0.3}, [0]),
    "within labels": ([("table", [0, 0, 50, 50], 0.9), ("text", [5, 5, 55, 55], 0.95)], {"iou": 0.3, "across_labels": False}, [0, 1]),
    "little overlap": ([("text", [0, 0, 50, 50], 0.9), ("text", [40, 40, 90, 90], 0.8)], {}, [0, 1]),
    "title first": ([("title", [0, 0, 100, 30], 0.8), ("text", [5, 5, 95, 25], 0.95)], {"containment": 0.8}, [0]),
    "table first": ([("table", [0, 0, 100, 100], 0.7), ("plain text", [10, 10, 90, 90], 0.9)], {}, [0]),
    "off": ([("table", [0, 0, 100, 100], 0.9), ("text", [10, 10, 90, 90], 0.8)], {"enabled": False}, [0, 1]),
    "partly inside": ([("table", [0, 0, 70, 70], 0.9), ("text", [40, 40, 90, 90], 0.8)], {}, [0, 1]),
    "high threshold": ([("text", [0, 0, 50, 50], 0.9), ("text", [20, 20, 70, 70], 0.7)], {"iou": 0.9}, [0, 1]),
    "none": ([], {}, []),
    "one": ([("text", [0, 0, 100, 100], 0.9)], {}, [0]),
    "no area": ([("text", [0, 0, 100, 100], 0.9), ("text", [50, 50, 50, 50], 0.8)], {}, [0, 1]),
    "unknown labels": ([("unknown", [0, 0, 100, 100], 0.9), ("other", [10, 10, 90, 90], 0.8)], {}, [0]),
}


def kept(boxes, how):
    b = np.array([x[1] for x in boxes], dtype=float).reshape(-1, 4)
    return L.filter_boxes(b, [x[0] for x in boxes], np.array([x[2] for x in boxes]), L.BoxConfig(**how))


@pytest.mark.parametrize("name", CASES)
def test_boxes(name):
    boxes, how, want = CASES[name]
    assert kept(boxes, how)[0].tolist() == want


def test_stats():
    _, _, s = kept([("table", [0, 0, 100, 100], 0.9), ("text", [10, 10, 90, 90], 0.8), ("figure", [200, 200, 300, 300], 0.85)], {})
    assert (s["input_count"], s["output_count"], s["containment_removed"], s["removed_by_label"]) == (3, 2, 1, {"text": 1})


def test_soft_suppression():
    boxes = [("text", [0, 0, 10, 10], 0.9), ("text", [0, 0, 10, 8], 0.6)]
    idx, scores, _ = kept(boxes, {"soft": True, "sigma": 0.3, "iou": 0.95, "containment": 2.0})
    assert idx.tolist() == [0] and scores.tolist() == [0.9]  # 0.6 * exp(-0.64 / 0.3) < 0.1
    idx, scores, _ = kept(boxes, {"soft": True, "sigma": 5.0, "iou": 0.95, "containment": 2.0})
    assert scores.tolist() == pytest.approx([0.9, 0.6 * np.exp(-0.64 / 5)])


box = st.tuples(st.integers(0, 90), st.integers(0, 90), st.integers(1, 60), st.integers(1, 60))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["text", "table", "title", "figure_caption", "odd"]), box, st.floats(0.1, 1)), max_size=14), st.booleans())
def test_kept_is_a_subset_without_overlap(items, soft):
    boxes = [(a, [x, y, x + w, y + h], c) for a, (x, y, w, h), c in items]
    idx, scores, s = kept(boxes, {"soft": soft})
    assert len(set(idx.tolist())) == len(idx) == len(scores) == s["output_count"]
    assert s["input_count"] - s["containment_removed"] - s["iou_removed"] - s["soft_nms_removed"] == len(idx)


def order(boxes, width=600, height=800):
    page = L._Page(np.array([b for _, b in boxes], dtype=float), [a for a, _ in boxes], width, height, L.OrderConfig())
    return page.order()


def test_two_columns_with_title():
    boxes = [("text", [310, 100, 590, 300]), ("text", [10, 320, 290, 600]), ("title", [10, 10, 590, 50]), ("text", [10, 100, 290, 300]), ("text", [310, 320, 590, 600])]
    assert order(boxes)[0] == [2, 3, 1, 0, 4]


def test_caption_follows_its_figure():
    boxes = [("text", [10, 10, 290, 100]), ("figure", [10, 120, 290, 300]), ("figure_caption", [10, 305, 290, 320]), ("text", [10, 340, 290, 400])]
    assert order(boxes)[0] == [0, 1, 2, 3]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["text", "table", "title", "table_caption", "figure"]), box), min_size=1, max_size=15))
def test_order_is_a_permutation(items):
    boxes = [(a, [x, y, x + w, y + h]) for a, (x, y, w, h) in items]
    assert sorted(order(boxes, 150, 150)[0]) == list(range(len(boxes)))


def test_frames(spark):
    rows = [("d", p, i, [float(v) for v in b], a, c, 600, 800) for p in (1, 2) for i, (a, b, c) in enumerate(CASES["text in table"][0] + [("title", [200, 200, 300, 300], 0.5)])]
    df = spark.createDataFrame(rows, "document_id string, page_number int, pos int, bbox array<double>, label string, confidence double, page_width int, page_height int")
    got = L.filter_detections(df).collect()
    assert [(r["page_number"], r["pos"]) for r in sorted(got, key=lambda r: (r["page_number"], r["pos"]))] == [(1, 0), (1, 2), (2, 0), (2, 2)]
    assert {r["containment_removed"] for r in got} == {1}
    assert sorted((r["page_number"], r["reading_order"]) for r in L.reading_order(df).collect()) == [(p, i) for p in (1, 2) for i in (1, 2, 3)]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9).flatmap(lambda n: st.lists(st.lists(st.tuples(st.sampled_from(["text", "Table", "title", "figure", "figure_caption", "odd"]), box, st.sampled_from([0.15, 0.3, 0.5, 0.9])), min_size=n, max_size=n), min_size=1, max_size=6)), st.booleans(), st.booleans())
def test_pages_together_are_as_each_alone(pages, soft, across):
    cfg = L.BoxConfig(soft=soft, sigma=0.3, across_labels=across)
    names = sorted({a.lower() for p in pages for a, *_ in p})
    boxes = np.array([[[x, y, x + w, y + h] for _, (x, y, w, h), _ in p] for p in pages], dtype=float)
    scores = np.array([[c for *_, c in p] for p in pages])
    stay, score, removed, stats = L.filter_pages(boxes, np.array([[names.index(a.lower()) for a, *_ in p] for p in pages]), names, scores, cfg)
    for i, p in enumerate(pages):
        idx, left, s = L.filter_boxes(boxes[i], [a for a, *_ in p], scores[i], cfg)
        assert np.flatnonzero(stay[i]).tolist() == idx.tolist() and score[i][idx].tolist() == pytest.approx(left.tolist())
        assert {names[k]: c for k, c in enumerate(removed[i].tolist()) if c} == s.pop("removed_by_label")
        assert {k: int(v[i]) for k, v in stats.items()} == s


def test_flat_rows_over_batches(spark):
    """Pages of 1 to 70 boxes in Arrow batches of 16 rows: each page as it is alone, and none collected into lists."""
    rng = np.random.default_rng(3)
    rows = []
    for p, n in enumerate((1, 2, 33, 7, 70, 7, 1, 15, 16, 17)):
        for i in range(n):
            x, y, w, h = rng.integers(1, 90, 4).tolist()
            rows.append((str(p % 2), p // 2, i, [float(x), float(y), float(x + w), float(y + h)], ["text", "Title", "table"][int(rng.integers(3))], float(rng.random()), 150, 150))
    df = spark.createDataFrame(rows, "document_id string, page_number int, pos int, bbox array<double>, label string, confidence double, page_width int, page_height int").orderBy("confidence")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        kept, read = L.filter_detections(df, L.BoxConfig.service()), L.reading_order(df)
        for made in (kept, read):
            assert "collect_list" not in made._jdf.queryExecution().optimizedPlan().toString()
        kept, read = kept.collect(), read.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want, lines = [], []
    for page in sorted({r[:2] for r in rows}):
        own = [r for r in rows if r[:2] == page]
        idx, scores, s = L.filter_boxes(np.array([r[3] for r in own]), [r[4] for r in own], np.array([r[5] for r in own]), L.BoxConfig.service())
        text = ",".join(f"{k}={v}" for k, v in sorted(s["removed_by_label"].items()))
        want += [(*page, own[i][2], own[i][3], own[i][4], round(float(c), 9), s["input_count"], s["output_count"], text) for i, c in zip(idx.tolist(), scores, strict=True)]
        line, wide = L._Page(np.array([r[3] for r in own]), [r[4] for r in own], 150.0, 150.0, L.OrderConfig()).order()
        lines += [(*page, own[i][2], k, wide[i]) for k, i in enumerate(line, 1)]
    assert sorted((r["document_id"], r["page_number"], r["pos"], r["bbox"], r["label"], round(r["confidence"], 9), r["input_count"], r["output_count"], r["removed_by_label"]) for r in kept) == sorted(want)
    assert sorted((r["document_id"], r["page_number"], r["pos"], r["reading_order"], r["is_cross_layout"]) for r in read) == sorted(lines)
