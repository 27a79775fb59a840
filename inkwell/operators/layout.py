"""Page layout: duplicate-box filtering and reading order, a page at a time (a page holds a bounded number of boxes).

Rows: document_id, page_number, pos (place in the detector's list), bbox (x1, y1, x2, y2), label, confidence.
"""

from __future__ import annotations

import itertools
import math
import statistics
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import domain as D

PAGE = ["document_id", "page_number"]
OTHER_PRIORITY = 5


@dataclass(frozen=True)
class BoxConfig:
    """Thresholds of the box filter. `service()` is the setting of the service, with soft suppression."""

    enabled: bool = True
    containment: float = 0.85
    least_area_ratio: float = 0.1
    iou: float = 0.5
    across_labels: bool = True
    soft: bool = False
    sigma: float = 0.5
    least_score: float = 0.1
    priority: dict = field(default_factory=lambda: dict(D.BOX_PRIORITY))
    nested: frozenset = frozenset(D.NESTED_LABELS)

    @staticmethod
    def service() -> BoxConfig:
        return BoxConfig(soft=True, sigma=0.3)


def _overlaps(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Areas, and the areas of all pairs' intersections."""
    side = np.maximum(0.0, b[:, 2:] - b[:, :2])
    low, high = np.maximum(b[:, None, :2], b[None, :, :2]), np.minimum(b[:, None, 2:], b[None, :, 2:])
    return side.prod(axis=1), np.maximum(0.0, high - low).prod(axis=2)


def filter_boxes(boxes: np.ndarray, labels: list[str], scores: np.ndarray, cfg: BoxConfig) -> tuple[np.ndarray, np.ndarray, dict]:
    """Indices kept, their confidences, and the counts of what each step removed."""
    n = len(labels)
    stats = {"input_count": n, "output_count": n, "containment_removed": 0, "iou_removed": 0, "soft_nms_removed": 0, "removed_by_label": {}}
    scores = np.asarray(scores, dtype=float)
    if not cfg.enabled or not n:
        return np.arange(n), scores, stats
    names = [x.lower() for x in labels]
    rank = np.array([cfg.priority.get(x, OTHER_PRIORITY) for x in names])
    area, both = _overlaps(boxes)
    union = area[:, None] + area[None] - both
    iou = np.divide(both, union, out=np.zeros_like(both), where=(union > 0) & (both > 0))

    def drop(i: int) -> None:
        stats["removed_by_label"][names[i]] = stats["removed_by_label"].get(names[i], 0) + 1

    # containment: a box mostly inside one of no lower priority goes; pairs in list order, a box that is gone
    # when its turn comes first starts no more pairs
    small, large = np.minimum(area[:, None], area[None]), np.maximum(area[:, None], area[None])
    inside = (small > 0) & (small >= cfg.least_area_ratio * large) & (both >= cfg.containment * np.where(small > 0, small, 1))
    gone: set[int] = set()
    for i in range(n):
        if i in gone:
            continue
        for j in np.flatnonzero(inside[i, i + 1 :]) + i + 1:
            if int(j) in gone:
                continue
            inner, outer = (i, int(j)) if area[i] < area[j] else (int(j), i)
            if (names[outer], names[inner]) not in cfg.nested and rank[outer] <= rank[inner]:
                if inner not in gone:
                    gone.add(inner)
                drop(inner)
    left = [i for i in range(n) if i not in gone]
    stats["containment_removed"] = n - len(left)

    # greedy suppression, best first
    best = sorted(left, key=lambda i: (rank[i], -scores[i]))
    kept: list[int] = []
    for i in best:
        rivals = (k for k in kept if (cfg.across_labels or names[k] == names[i]) and iou[k, i] > cfg.iou)
        if next(rivals, None) is None:
            kept.append(i)
        else:
            drop(i)
    stats["iou_removed"] = len(left) - len(kept)
    kept.sort()

    if cfg.soft:
        score = {i: float(scores[i]) for i in kept}
        for at, i in enumerate(kept):
            for j in kept[at + 1 :]:
                if iou[i, j] > 0:
                    weaker = j if rank[i] < rank[j] or rank[i] == rank[j] and score[i] > score[j] else i
                    score[weaker] *= math.exp(-(iou[i, j] ** 2) / cfg.sigma)
        stay = [i for i in kept if score[i] >= cfg.least_score]
        for i in kept:
            if score[i] < cfg.least_score:
                drop(i)
        stats["soft_nms_removed"] = len(kept) - len(stay)
        kept, scores = stay, np.array([score[i] for i in stay])
    else:
        scores = scores[kept]
    stats["output_count"] = len(kept)
    return np.array(kept, dtype=int), scores, stats


def filter_pages(boxes: np.ndarray, codes: np.ndarray, names: list[str], scores: np.ndarray, cfg: BoxConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
    """filter_boxes of many pages of n boxes each, step by step for all of them at once.

    boxes (pages, n, 4), codes (pages, n) of the labels in `names` (lower case), scores (pages, n); the boxes kept
    (pages, n), their confidences, what was removed (pages, names) and the counts.
    """
    p, n = codes.shape
    every = np.arange(p)
    rank_of = np.array([cfg.priority.get(x, OTHER_PRIORITY) for x in names])
    nested = np.array([[(o, i) in cfg.nested for i in names] for o in names], dtype=bool).reshape(len(names), len(names))
    rank, scores = rank_of[codes], scores.astype(float)
    removed = np.zeros((p, len(names)), dtype=np.int64)
    zero = np.zeros(p, dtype=np.int32)
    if not cfg.enabled:
        return np.ones((p, n), dtype=bool), scores, removed, {"input_count": zero + n, "output_count": zero + n, "containment_removed": zero, "iou_removed": zero, "soft_nms_removed": zero}
    area = np.maximum(0.0, boxes[..., 2:] - boxes[..., :2]).prod(axis=2)
    low, high = np.maximum(boxes[:, :, None, :2], boxes[:, None, :, :2]), np.minimum(boxes[:, :, None, 2:], boxes[:, None, :, 2:])
    both = np.maximum(0.0, high - low).prod(axis=3)
    union = area[:, :, None] + area[:, None] - both
    iou = np.divide(both, union, out=np.zeros_like(both), where=(union > 0) & (both > 0))

    small, large = np.minimum(area[:, :, None], area[:, None]), np.maximum(area[:, :, None], area[:, None])
    inside = (small > 0) & (small >= cfg.least_area_ratio * large) & (both >= cfg.containment * np.where(small > 0, small, 1))
    gone = np.zeros((p, n), dtype=bool)
    for i in range(n):
        at = np.flatnonzero(~gone[:, i])
        for j in range(i + 1, n):
            h = at[inside[at, i, j] & ~gone[at, j]]
            if not len(h):
                continue
            first = area[h, i] < area[h, j]
            inner, outer = np.where(first, codes[h, i], codes[h, j]), np.where(first, codes[h, j], codes[h, i])
            goes = ~nested[outer, inner] & (rank_of[outer] <= rank_of[inner])
            gone[h[goes], np.where(first, i, j)[goes]] = True
            removed[h[goes], inner[goes]] += 1
    left = ~gone

    kept = np.zeros((p, n), dtype=bool)
    order = np.lexsort((-scores, rank), axis=1)
    for o in order.T:
        rival = kept & (iou[every, o] > cfg.iou)
        if not cfg.across_labels:
            rival &= codes == codes[every, o][:, None]
        mine, rival = left[every, o], rival.any(axis=1)
        kept[every, o] = mine & ~rival
        lost = np.flatnonzero(mine & rival)
        removed[lost, codes[lost, o[lost]]] += 1

    stay = kept
    if cfg.soft:
        for i in range(n):
            for j in range(i + 1, n):
                h = np.flatnonzero(kept[:, i] & kept[:, j] & (iou[:, i, j] > 0))
                weaker = np.where((rank[h, i] < rank[h, j]) | (rank[h, i] == rank[h, j]) & (scores[h, i] > scores[h, j]), j, i)
                scores[h, weaker] *= np.exp(-(iou[h, i, j] ** 2) / cfg.sigma)
        stay = kept & (scores >= cfg.least_score)
        page, box = np.nonzero(kept & ~stay)
        np.add.at(removed, (page, codes[page, box]), 1)
    counts = [x.sum(axis=1).astype(np.int32) for x in (left, kept, stay)]
    return stay, scores, removed, {"input_count": zero + n, "output_count": counts[2], "containment_removed": n - counts[0], "iou_removed": counts[0] - counts[1], "soft_nms_removed": counts[1] - counts[2]}


#: Up to so many boxes, pages of one size are filtered together; a larger one alone.
TOGETHER = 32


def _by_page(detections: DataFrame, extra: list[str], fn: Callable[[pa.RecordBatch, np.ndarray], tuple[np.ndarray, dict[str, np.ndarray | list]]], element: str) -> DataFrame:
    """Pages through fn, many at once: rows of whole pages in list order and the places where pages begin (and the end);
    it returns the rows that stay and the columns of `element` beside them ("confidence" in the place of the old one).

    Rows are dealt and sorted by page and travel flat; the last page of an Arrow batch waits for the next batch.
    extra: more columns that fn reads.
    """
    own = [F.col("document_id").cast("string").alias("document_id"), F.col("page_number").cast("int").alias("page_number"), F.col("pos").cast("int").alias("pos"), F.col("bbox").cast("array<double>").alias("bbox"), "label", F.col("confidence").cast("double").alias("confidence")]
    rows = detections.select(*own, *extra).repartition(*PAGE).sortWithinPartitions("page_number", "document_id", "pos", "bbox", "label", "confidence")
    names, kinds = zip(*[x.strip().split(" ") for x in element.split(",")], strict=True)
    shown = [*PAGE, "pos", "bbox", "label", "confidence"]

    def starts(b: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(len(b), dtype=bool)
        new[:1] = True
        document, page = b.column("document_id").dictionary_encode().indices, b.column("page_number")
        for x in (document.fill_null(-1), page.fill_null(0), page.is_null()):
            v = x.to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    def made(b: pa.RecordBatch, at: np.ndarray) -> pa.RecordBatch:
        keep, columns = fn(b, np.append(at, len(b)))
        out = b.select(shown).take(pa.array(keep))
        new = {n: pa.array(columns[n], type=_arrow(k)) for n, k in zip(names, kinds, strict=True)}
        return pa.RecordBatch.from_arrays([new.pop(n) if n in new else out.column(n) for n in shown] + list(new.values()), [*shown, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for b in batches:
            if not len(b):
                continue
            if waiting is not None:
                b = pa.Table.from_batches([waiting, b]).combine_chunks().to_batches()[0]
            at = starts(b)
            if at[-1]:
                yield made(b.slice(0, at[-1]), at[:-1])
            waiting = b.slice(at[-1])
        if waiting is not None:
            yield made(waiting, np.zeros(1, dtype=np.int64))

    added = ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True) if n not in shown)
    return rows.mapInArrow(run, f"document_id string, page_number int, pos int, bbox array<double>, label string, confidence double, {added}")


def _arrow(kind: str) -> pa.DataType:
    return {"int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}[kind]


def _corners(b: pa.RecordBatch) -> np.ndarray:
    return b.column("bbox").flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)


def filter_detections(detections: DataFrame, cfg: BoxConfig | None = None) -> DataFrame:
    """The boxes kept, with their (soft) confidence, and each page's counts beside every row."""
    cfg = cfg or BoxConfig()
    counts = ["input_count", "output_count", "containment_removed", "iou_removed", "soft_nms_removed"]

    def run(b: pa.RecordBatch, at: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray | list]]:
        boxes, scores = _corners(b), b.column("confidence").to_numpy(zero_copy_only=False)
        coded = b.column("label").dictionary_encode()
        lower = [x.lower() for x in coded.dictionary.to_pylist()]
        names = sorted(set(lower))
        codes = np.array([names.index(x) for x in lower])[coded.indices.to_numpy(zero_copy_only=False)]
        size = np.diff(at)
        stay, out = np.zeros(len(b), dtype=bool), {k: np.zeros(len(b), dtype=np.int32) for k in counts}
        score, removed = np.zeros(len(b)), np.zeros(len(b), dtype=object)
        for n in np.unique(size).tolist():
            first = at[:-1][size == n]
            step = len(first) if n <= TOGETHER else 1
            for x in range(0, len(first), step):
                rows = first[x : x + step, None] + np.arange(n)
                if n <= TOGETHER:
                    kept, score[rows], gone, stats = filter_pages(boxes[rows], codes[rows], names, scores[rows], cfg)
                    stay[rows] = kept
                    kinds, which = np.unique(gone, axis=0, return_inverse=True)
                    text = np.array([",".join(f"{names[i]}={c}" for i, c in enumerate(k) if c) for k in kinds.tolist()], dtype=object)
                    removed[rows] = text[which.reshape(-1)][:, None]
                    for k in counts:
                        out[k][rows] = stats[k][:, None]
                else:
                    kept, left, stats = filter_boxes(boxes[rows[0]], [names[c] for c in codes[rows[0]].tolist()], scores[rows[0]], cfg)
                    stay[rows[0][kept]], score[rows[0][kept]] = True, left
                    removed[rows[0]] = ",".join(f"{k}={v}" for k, v in sorted(stats["removed_by_label"].items()))
                    for k in counts:
                        out[k][rows] = stats[k]
        keep = np.flatnonzero(stay)
        return keep, {"confidence": score[keep], "removed_by_label": removed[keep].tolist()} | {k: v[keep] for k, v in out.items()}

    return _by_page(detections, [], run, "confidence double, " + ", ".join(f"{c} int" for c in counts) + ", removed_by_label string")


@dataclass(frozen=True)
class OrderConfig:
    spanning_factor: float = 1.3
    page_share: float = 0.7
    density: float = 0.9
    caption_distance: float = 100
    gap_share: float = 0.02
    depth: int = 10
    least_elements: int = 2
    premask: frozenset = frozenset({"title", "figure", "table"})
    spanning: frozenset = frozenset({"title", "abandon"})


class _Page:
    """The boxes of one page; elements are indices. Plain numbers: pages are small, so arrays would cost more than they hold."""

    BINS, BANDS = 100, 10

    def __init__(self, boxes: list | np.ndarray, labels: list[str], width: float, height: float, cfg: OrderConfig) -> None:
        self.b = boxes.tolist() if isinstance(boxes, np.ndarray) else boxes
        self.labels, self.w, self.h, self.cfg = labels, width, height, cfg
        self.c = [((x1 + x2) / 2, (y1 + y2) / 2) for x1, y1, x2, y2 in self.b]

    def cuts(self, items: list[int], low: float, high: float, axis: int) -> list[float]:
        """Middles of the empty runs of the projection profile that content follows."""
        if high <= low or not items:
            return []
        size = (high - low) / self.BINS
        filled = 0  # a bit for each bin
        for i in items:
            box = self.b[i]
            a, z = int((box[axis] - low) / size), min(self.BINS - 1, int((box[axis + 2] - low) / size)) + 1
            a = a if a > 0 else 0
            z = z if z >= 0 else max(0, z + self.BINS + 1)
            if a < z:
                filled |= (1 << z) - (1 << a)
        least = max(2, int(self.BINS * self.cfg.gap_share))
        out, k = [], 0
        while filled >> k:
            rest = filled >> k
            start, k = k, k + (rest & -rest).bit_length() - 1
            if k >= self.BINS:
                break
            if k - start >= least:
                out.append(low + (start + k) / 2 * size)
            rest = ~(filled >> k)
            k += (rest & -rest).bit_length() - 1
        return out

    def split(self, items: list[int], region: tuple, axis: int) -> list[tuple[list[int], tuple]]:
        """Groups of items between the cuts along an axis, with their regions."""
        low, high = region[axis], region[axis + 2]
        edges = [low, *self.cuts(items, low, high, axis)]
        if len(edges) == 1:
            return [(items, region)]
        out = []
        for k, a in enumerate(edges):
            z = edges[k + 1] if k + 1 < len(edges) else math.inf
            part = [i for i in items if a <= self.c[i][axis] < z]
            if part:
                r = list(region)
                r[axis], r[axis + 2] = a, min(z, high) if z is math.inf else z
                out.append((part, tuple(r)))
        return out or [(items, region)]

    def rows_first(self, items: list[int], region: tuple) -> bool:
        """Whether the centres vary much more by height than by breadth."""
        left, top, right, bottom = region
        size = (right - left, bottom - top)
        inside = [c for c in (self.c[i] for i in items) if left <= c[0] <= right and top <= c[1] <= bottom]
        if min(size) <= 0 or not inside:
            return True
        mean, spread = len(inside) / self.BANDS, []
        for axis in (0, 1):
            counts = [0] * self.BANDS
            for c in inside:
                counts[min(self.BANDS - 1, int((c[axis] - region[axis]) / size[axis] * self.BANDS))] += 1
            v = [(k - mean) * (k - mean) for k in counts]
            # in the order in which numpy adds
            spread.append(((v[0] + v[1]) + (v[2] + v[3])) + ((v[4] + v[5]) + (v[6] + v[7])) + v[8] + v[9])
        return sum(spread) == 0 or spread[1] / sum(spread) > self.cfg.density

    def segments(self, items: list[int], region: tuple, depth: int = 0) -> list[list[int]]:
        if not items or depth >= self.cfg.depth or len(items) < self.cfg.least_elements:
            return [items] if items else []
        first = 1 if self.rows_first(items, region) else 0
        out: list[list[int]] = []
        for part, r in self.split(items, region, first):
            for sub, q in self.split(part, r, 1 - first):
                out += self.segments(sub, q, depth + 1) if len(sub) > self.cfg.least_elements else [sub]
        return out or [items]

    def distance(self, a: int, b: int) -> tuple[float, float]:
        """Edge distance, and the matching distance of a caption a to a parent b."""
        p, q = self.b[a], self.b[b]
        h, v = max(0.0, q[0] - p[2], p[0] - q[2]), max(0.0, q[1] - p[3], p[1] - q[3])
        edge = math.hypot(h, v)
        both = max(0.0, min(p[2], q[2]) - max(p[0], q[0])) * max(0.0, min(p[3], q[3]) - max(p[1], q[1]))
        union = sum(max(0.0, x[2] - x[0]) * max(0.0, x[3] - x[1]) for x in (p, q)) - both
        overlap = both / union if both > 0 and union > 0 else 0.0
        top = p[1] - q[3]
        drop = abs(top) * (2 if top < -20 else 1)
        m = max(self.w, self.h)
        if m <= 0:
            return edge, 0.0
        return edge, m * m * (1 - overlap) + edge + drop / m + abs(self.c[a][0] - self.c[b][0]) / m / m

    def order(self) -> tuple[list[int], list[bool]]:
        """All elements in reading order, and which of them span the layout."""
        n, b, labels = len(self.labels), self.b, self.labels
        masked = [i for i in range(n) if labels[i] in self.cfg.premask]
        plain = [i for i in range(n) if labels[i] not in self.cfg.premask]
        wide = [False] * n
        if plain:
            widths = {i: b[i][2] - b[i][0] for i in plain}
            limit = self.cfg.spanning_factor * statistics.median(widths.values())
            for i in plain:
                wide[i] = bool(widths[i] >= limit or widths[i] >= self.w * self.cfg.page_share or labels[i] in self.cfg.spanning)
        groups = self.segments([i for i in plain if not wide[i]], (0.0, 0.0, self.w, self.h))
        line = [i for g in groups for i in sorted(g, key=lambda i: (b[i][1], b[i][0]))]
        for i in [*(i for i in plain if wide[i]), *masked]:
            at = next((k for k, other in enumerate(line) if self.c[other][1] > self.c[i][1]), len(line))
            line.insert(at, i)
        key = {i: float(k) for k, i in enumerate(line)}
        for i in list(line):
            want = D.CAPTION_OF.get(labels[i])
            near = [(self.distance(i, j), j) for j in line if labels[j] == want] if want else []
            near = [(d[1], k, j) for k, (d, j) in enumerate(near) if d[0] <= self.cfg.caption_distance]
            if near:
                key[i] = key[min(near)[2]] + 0.1
        line.sort(key=lambda i: (key[i], D.ORDER_PRIORITY.get(labels[i], OTHER_PRIORITY), b[i][1], b[i][0]))
        return line, wide


def spanning_limit(cfg: OrderConfig) -> Column:
    """An aggregate: the width from which a page's box spans the layout, by the median of those that are not masked."""
    width = F.element_at("bbox", 3).cast("double") - F.element_at("bbox", 1).cast("double")
    return cfg.spanning_factor * F.median(F.when(~F.col("label").isin(*sorted(cfg.premask)), width))


def spanning_limits(detections: DataFrame, cfg: OrderConfig | None = None) -> DataFrame:
    """document_id, page_number, spanning_limit."""
    return detections.groupBy(*PAGE).agg(spanning_limit(cfg or OrderConfig()).alias("spanning_limit"))


def removed_counts(filtered: DataFrame) -> DataFrame:
    """label, removed over all pages of filter_detections' rows."""
    pages = filtered.select(*PAGE, "removed_by_label").distinct().where("removed_by_label <> ''")
    each = pages.select(F.explode(F.split("removed_by_label", ",")).alias("x"))
    return each.groupBy(F.substring_index("x", "=", 1).alias("label")).agg(F.sum(F.substring_index("x", "=", -1).cast("long")).alias("removed"))


def reading_order(detections: DataFrame, cfg: OrderConfig | None = None) -> DataFrame:
    """document_id, page_number, pos, bbox, label, confidence, reading_order (from 1), is_cross_layout.

    Rows need page_width and page_height too.
    """
    cfg = cfg or OrderConfig()

    def run(b: pa.RecordBatch, at: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray | list]]:
        boxes, labels = _corners(b).tolist(), b.column("label").to_pylist()
        width, height = (b.column(c).to_numpy(zero_copy_only=False).astype(float).tolist() for c in ("page_width", "page_height"))
        rows, places, spans = [], [], []
        for a, z in itertools.pairwise(at.tolist()):
            line, wide = _Page(boxes[a:z], labels[a:z], width[a], height[a], cfg).order()
            rows += [a + i for i in line]
            places += range(1, z - a + 1)
            spans += [wide[i] for i in line]
        return np.array(rows, dtype=np.int64), {"reading_order": places, "is_cross_layout": spans}

    return _by_page(detections, ["page_width", "page_height"], run, "reading_order int, is_cross_layout boolean")
