"""Quality classification by positive-unlabelled learning.

Trusted positives are documents of the learning fold with label 1; the unlabelled set is a sample of all
documents, whatever their labels. Labels 0 are not used. A small network over shape statistics of the whole text
minimises the non-negative unbiased risk  pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))  with the sigmoid loss (where
the bracket falls below zero, the step goes against it). The class prior pi is estimated by the best bin: of the
score thresholds of a positive-against-unlabelled model, on rows it was not fitted to, the one that gives the least
upper confidence bound of (share of unlabelled above) / (share of positives above). The score is the sigmoid of
the network's output, shifted so that its mean over the unlabelled sample is the prior.

The features of a document are a few numbers made in one pass of its text, in the tasks that read it; only those
of the bounded samples come to the driver.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import cut, filter_rows, held_out, learning_labels, map_rows, sigmoid

#: Most trusted positives and unlabelled rows that are fitted, the first by hash; share of them that estimates the prior.
POSITIVES, UNLABELLED, HELD_BACK = 8000, 16000, 0.3
#: Hidden units, passes and seed of the network.
HIDDEN, EPOCHS, SEED = 24, 60, 3
#: A document is taken for good at this score.
THRESHOLD = 0.3

_CLASS = np.zeros(256, dtype=np.int64)
for _set, _k in ((range(65, 91), 1), (range(97, 123), 2), (range(48, 58), 3), (b"!", 4), (b"|", 5), (b"#$%&*@^~=<>+\\/", 6), (b".,;:?'\"()-", 7), (b" \t", 8), (b"\r\n", 9), (range(128, 256), 10)):
    for _c in _set:
        _CLASS[_c] = _k
FEATURES = 26


def features(text: str | None) -> list[float]:
    """The shape statistics of a text; zeros for one without words."""
    b = (text or "").encode("utf-8", "surrogatepass")
    words = b.split()
    n = len(words)
    if not n:
        return [0.0] * FEATURES
    share = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(b, dtype=np.uint8), minlength=256), minlength=11) / len(b)
    distinct = len(set(words))
    again = sum(map(bytes.__eq__, words[1:], words)) if n > 1 else 0
    lines = [x for x in b.split(b"\n") if x]
    upper = sum(map(bytes.isupper, words))
    # bytes.isalnum is for ASCII: the last byte of a word that ends in another letter is over 127
    odd = sum(w[-1] < 128 and not w[-1:].isalnum() and w[-1] not in b".,;:?'\")-" for w in words)
    top = Counter(words).most_common(1)[0][1] / n
    packed = len(zlib.compress(b, 1)) / len(b)
    length = np.log1p(n)
    return [1.0, length, length * length / 10, float(n < 5), float(n < 20), len(b) / n / 10, distinct / n, distinct / n * length, np.log1p(distinct), again / n, upper / n, odd / n, len(lines) / n, len(set(lines)) / len(lines), packed, top, *share[1:].tolist()]


@dataclass(frozen=True)
class Model:
    """Scaling, two layers and the shift of the score."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    offset: float = 0.0

    def output(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.maximum(0, z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.output(x) + self.offset)


def _mean_loss(par: list[np.ndarray], z: np.ndarray, sign: float) -> tuple[float, list[np.ndarray]]:
    """Mean sigmoid loss of the network's output * sign, and its gradient."""
    h = np.maximum(0, z @ par[0] + par[1])
    g = h @ par[2] + par[3]
    loss = sigmoid(-sign * g)
    dg = -sign * loss * (1 - loss) / len(z)
    dh = np.outer(dg, par[2]) * (h > 0)
    return float(loss.mean()), [z.T @ dh, dh.sum(axis=0), h.T @ dg, np.array([dg.sum()])]


def risk(par: list[np.ndarray], p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, list[np.ndarray]]:
    """The non-negative unbiased risk and the step's direction: its gradient, or, where the negatives' estimate is below zero, away from that."""
    lp, gp = _mean_loss(par, p, 1)
    ln, gn = _mean_loss(par, p, -1)
    lu, gu = _mean_loss(par, u, -1)
    if lu - prior * ln >= 0:
        return prior * lp + lu - prior * ln, [prior * a + c - prior * b for a, b, c in zip(gp, gn, gu, strict=True)]
    return prior * lp, [prior * b - c for b, c in zip(gn, gu, strict=True)]


def fit_pu(p: np.ndarray, u: np.ndarray, prior: float, seed: int = SEED, epochs: int = EPOCHS) -> Model:
    """Minimise the risk over positives p and unlabelled u by Adam on small batches."""
    rng = np.random.default_rng(seed)
    mean, scale = u.mean(axis=0), u.std(axis=0) + 1e-6
    d = p.shape[1]
    par = [rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(x) for x in par], [np.zeros_like(x) for x in par], 0
    zp, zu = (np.clip((x - mean) / scale, -6, 6) for x in (p, u))
    steps = max(1, len(zu) // 256)
    for _ in range(epochs):
        pp, uu = rng.permutation(len(zp)), rng.permutation(len(zu))
        for bp, bu in zip(np.array_split(pp, steps), np.array_split(uu, steps), strict=True):
            bp = bp if len(bp) else pp[:1]
            _, g = risk(par, zp[bp], zu[bu], prior)
            t += 1
            for i, x in enumerate(g):
                x = x + 1e-4 * par[i]
                m[i] = 0.9 * m[i] + 0.1 * x
                v[i] = 0.999 * v[i] + 0.001 * x * x
                par[i] = par[i] - 0.005 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, par[0], par[1], par[2], float(par[3][0]))


def best_bin(p: np.ndarray, u: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """The class prior from scores of held-back positives p and unlabelled u."""
    at = np.unique(np.concatenate([p, u]))
    above_p = 1 - np.searchsorted(np.sort(p), at) / len(p)
    above_u = 1 - np.searchsorted(np.sort(u), at) / len(u)
    some = above_p > 0
    above_p, above_u = above_p[some], above_u[some]
    slack = np.sqrt(np.log(4 / delta) / (2 * len(p))) + np.sqrt(np.log(4 / delta) / (2 * len(u)))
    i = int(((above_u + (1 + gamma) * slack) / above_p).argmin())
    return float(np.clip(above_u[i] / above_p[i], 0.01, 0.99))


def estimated_prior(p: np.ndarray, u: np.ndarray) -> float:
    """The share of positives among the unlabelled, from a model of positive against unlabelled; its rows and the held-back ones are disjoint."""
    np_, nu = int(len(p) * (1 - HELD_BACK)), int(len(u) * (1 - HELD_BACK))
    if not np_ or not nu:
        return 0.5
    rough = fit_pu(p[:np_], u[:nu], 0.5, seed=SEED + 1, epochs=EPOCHS // 2)
    return best_bin(rough.output(p[np_:]), rough.output(u[nu:]))


def shifted(model: Model, u: np.ndarray, prior: float) -> Model:
    """The model whose mean score over u is the prior."""
    low, high = -30.0, 30.0
    g = model.output(u)
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if sigmoid(g + mid).mean() < prior else (low, mid)
    return replace(model, offset=(low + high) / 2)


def featured(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, x (the features) of each row."""
    schema = pa.schema([("id", pa.int64()), ("x", pa.list_(pa.float64()))])
    return map_rows(docs, {"id": F.col(f"`{id_column}`").cast("long"), "text": F.col(f"`{text_column}`").cast("string")}, lambda b: {"id": b["id"], "x": [features(t) for t in b["text"]]}, schema)


def _sample(rows: DataFrame, n: int) -> np.ndarray:
    """The features of up to n distinct rows (id, x), those of least hash: all, if there are no more; fewer where many rows repeat. Little more than n rows move."""
    total = rows.count()
    share = min(1.0, (1.05 * n + 5 * n**0.5) / max(1, total))
    h = F.xxhash64("id", "x", F.lit(SEED))
    some = rows.where(h.cast("double") <= share * 2.0**64 - 2.0**63) if share < 1 else rows  # the least of signed hashes, as in the order below
    got = some.select("id", "x").distinct().select("x", h.alias("h"), "id").orderBy("h", "id").limit(n).collect()
    return np.array([r["x"] for r in got])


def train(rows: DataFrame, labels: DataFrame) -> Model:
    """Learn from the features of all documents and the ones among the labels of the learning fold.

    The samples are distinct rows of smallest hash, up to their bounds; without positives or documents every
    score is 0.5.
    """
    known = learning_labels(labels, "quality").where("y = 1").select(F.col("doc_id").alias("id"))
    positives = _sample(cut(rows.join(known, "id")), POSITIVES)
    unlabelled = _sample(rows, UNLABELLED)
    if not len(positives) or not len(unlabelled):
        return Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros((FEATURES, 1)), np.zeros(1), np.zeros(1), 0.0)
    prior = estimated_prior(positives, unlabelled)
    return shifted(fit_pu(positives, unlabelled, prior), unlabelled, prior)


def score_documents(rows: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted from the features."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(b: dict[str, list]) -> dict[str, list]:
        s = model.score(np.array(b["x"], dtype=np.float64).reshape(len(b["id"]), FEATURES))
        return {"doc_id": b["id"], "held_out": [held_out(i) for i in b["id"]], "score": s, "predicted": (s >= threshold).astype(np.int32)}

    return map_rows(rows, {"id": "id", "x": "x"}, run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted for each row of docs.

    Null and empty texts are scored by their (zero) features; a null id counts as empty text for held_out;
    repeated rows are scored each; an empty table gives an empty one; other columns are ignored.
    """
    rows = cut(featured(docs))
    return score_documents(rows, train(rows, labels), threshold)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_column: str = "text") -> DataFrame:
    """The rows of docs, with their own columns, whose score reaches the threshold."""

    def keep(b: dict[str, list]) -> list[bool]:
        x = np.array([features(t) for t in b["text"]]).reshape(len(b["text"]), FEATURES)
        return (model.score(x) >= threshold).tolist()

    return filter_rows(docs, {"text": F.col(f"`{text_column}`").cast("string")}, keep)
