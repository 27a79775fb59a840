"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, one on what toxic texts hold beyond it (words that
several unlike toxic samples share and no ordinary sample has; it also carries the ordinary dictionary's content,
so the two differ only in what toxic text adds). A text is cut into windows, one for each word (a longer word
gives several), framed by white space and a fixed carrier that both dictionaries hold and that gives the
compressor room to look ahead. A window counts as toxic when the toxic dictionary shortens it by at least a
calibrated number of bytes and a calibrated share of its length. A logistic regression on the number and share of
such windows gives the score. Workers remember the lengths of windows they have met. (Longer windows of running text
under dictionaries of the plain texts tell the two apart far worse where few words of a long text are toxic; the
README has the figures.)
"""

from __future__ import annotations

import collections
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import held, held_out, learning_labels, map_rows, sigmoid

#: Most toxic and ordinary documents of the learning fold that are fitted (first by hash of the id), and the most
#: characters of a document among them; of each, the share that trains dictionaries (the rest calibrates).
TOXIC, ORDINARY, SAMPLE_CHARS, TRAINS = 2400, 7000, 20_000, 0.7
#: Bytes of a window and of the dictionaries; windows that a worker remembers.
WINDOW, ORDINARY_BYTES, TOXIC_BYTES, CACHE = 48, 16384, 8192, 400_000
SEED, THRESHOLD = 13, 0.5

CARRIER = b"#~carrier~of~the~window~0123456789~#"
_SPLIT = re.compile(r"[\s.,;:!?\"'()\[\]{}|*#%&$<>=]+")


def words_of(text: str | None) -> list[str]:
    return [w for w in _SPLIT.split((text or "").lower()) if w]


def _trained(size: int, samples: list[bytes]) -> bytes:
    """A dictionary of the samples; too few samples to train on are the dictionary themselves."""
    import zstandard

    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _lengths(content: bytes):
    """window -> compressed length under a raw-content dictionary."""
    import zstandard as z

    d = z.ZstdCompressionDict(content + CARRIER, dict_type=z.DICT_TYPE_RAWCONTENT)
    how = z.ZstdCompressionParameters(strategy=z.STRATEGY_GREEDY, min_match=4, window_log=17, hash_log=15, chain_log=15, search_log=6, write_content_size=False, write_dict_id=False, write_checksum=False)
    d.precompute_compress(compression_params=how)
    pack = z.ZstdCompressor(dict_data=d, compression_params=how).compress
    return lambda b: len(pack(b" " + b + b" " + CARRIER))


@dataclass(frozen=True)
class Model:
    """Dictionaries, the window thresholds and the weights of the score."""

    ordinary: bytes
    toxic: bytes
    least_bytes: int = 3
    least_share: float = 0.3
    weights: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)


class Gains(dict):
    """word -> (bytes saved by the toxic dictionary, that as a share of the word), the largest of its windows."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.a, self.b = _lengths(model.ordinary), _lengths(model.toxic + model.ordinary)

    def __missing__(self, word: str) -> tuple[int, float]:
        b = word.encode("utf-8", "replace")
        best = (-99, 0.0)
        for i in range(0, len(b), WINDOW):
            w = b[i : i + WINDOW]
            gain = self.a(w) - self.b(w)
            best = max(best, (gain, gain / (len(w) + 2)))
        self[word] = best
        return best


def summary(gains: list[tuple[int, float]], least_bytes: int, least_share: float) -> tuple[float, ...]:
    """What the score is made of: 1, whether there are toxic windows, their number and their share."""
    k = sum(g >= least_bytes and s >= least_share for g, s in gains)
    return 1.0, float(k > 0), float(np.log1p(k)), 20.0 * k / max(1, len(gains))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (p - y) + 0.05 * w)
    return w


def fit(toxic: list[str], ordinary: list[str]) -> Model:
    """Learn from labelled texts; without texts of either kind every score is below one half."""
    if not toxic or not ordinary:
        return Model(b"", b"", weights=(-3.0, 0.0, 0.0, 0.0))
    nt, no = max(1, int(len(toxic) * TRAINS)), max(1, int(len(ordinary) * TRAINS))
    plain: set[str] = set()
    for t in ordinary[:no]:
        plain.update(words_of(t))
    seen: collections.Counter[str] = collections.Counter()
    kept = []
    for t in toxic[:nt]:
        own = set(words_of(t)) - plain
        if len(own) > 8 and sum(w in seen for w in own) > 0.6 * len(own):
            continue  # a near copy of a sample; its words would count twice
        seen.update(own)
        kept.append(t)
    least = max(2, int(np.ceil(0.004 * len(kept))))
    extra = [(" " + " ".join(w for w in words_of(t) if seen[w] >= least) + " ").encode() for t in kept]
    model = Model(_trained(ORDINARY_BYTES, [t.lower().encode("utf-8", "replace") for t in ordinary[:no]]), _trained(TOXIC_BYTES, extra))
    gains = Gains(model)
    check = [(t, 1) for t in toxic[nt:] or toxic] + [(t, 0) for t in ordinary[no:] or ordinary]
    each = [list(map(gains.__getitem__, words_of(t))) for t, _ in check]
    y = np.array([float(k) for _, k in check])
    best: tuple[float, Model] | None = None
    for least_bytes in (2, 3, 4, 5):
        for least_share in (0.0, 0.2, 0.3, 0.4):
            x = np.array([summary(g, least_bytes, least_share) for g in each])
            w = _logistic(x, y)
            p = np.clip(sigmoid(x @ w), 1e-6, 1 - 1e-6)
            loss = float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())
            if best is None or loss < best[0]:
                best = loss, Model(model.ordinary, model.toxic, least_bytes, least_share, tuple(w.tolist()))
    return best[1]


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """Learn from a bounded sample of the learning fold's labelled documents."""
    known = learning_labels(labels, "toxic").select(F.col("doc_id").alias("id"), "y")
    text = F.col(f"`{text_column}`").cast("string")
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), text.alias("text")).where(F.length("text").between(1, SAMPLE_CHARS))
    # ids first, so that only the sample's texts move; those of a hash under a limit, so that few more than the sample do
    first = F.xxhash64("id", F.lit(SEED))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    chosen = []
    for y, n in ((1, TOXIC), (0, ORDINARY)):
        share = (1.05 * n + 5 * n**0.5) / max(1, counts.get(y, 0))
        some = known.where(F.col("y") == y)
        if share < 1:
            some = some.where(first.cast("double") <= share * 2.0**64 - 2.0**63)  # the least of signed hashes, as in the order below
        chosen += [(r["id"], y) for r in some.orderBy(first, "id").limit(n).select("id").collect()]
    few = docs.sparkSession.createDataFrame(chosen, "id long, y int")  # at most TOXIC + ORDINARY ids
    # of the texts of a repeated id the one of least hash
    got = rows.join(F.broadcast(few), "id").groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("id", "y", "text", first.alias("h")).collect()
    got.sort(key=lambda r: (r["h"], r["id"]))
    return fit([r["text"] for r in got if r["y"] == 1], [r["text"] for r in got if r["y"] == 0])


def _worker(model: Model) -> Gains:
    g = held(f"gains {hash(model)}", lambda: Gains(model))
    if len(g) > CACHE:
        g.clear()
    return g


def score_documents(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, toxic_windows for each row; one pass, no shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("toxic_windows", pa.int64())])
    w = np.array(model.weights)

    def run(b: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": b["id"], "held_out": [held_out(i) for i in b["id"]], "score": [], "predicted": [], "toxic_windows": []}
        for t in b["text"]:
            gains = _worker(model)
            x = summary(list(map(gains.__getitem__, words_of(t))), model.least_bytes, model.least_share)
            s = float(sigmoid(np.dot(x, w)))
            out["score"].append(s)
            out["predicted"].append(int(s >= threshold))
            out["toxic_windows"].append(round(np.expm1(x[2])))
        return out

    return map_rows(docs, {"id": F.col(f"`{id_column}`").cast("long"), "text": F.col(f"`{text_column}`").cast("string")}, run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted, toxic_windows for each row of docs.

    Null and empty texts have no window and get the score of none; a null id counts as empty text for held_out;
    repeated rows are scored each; an empty table gives an empty one; other columns are ignored.
    """
    return score_documents(docs, train(docs, labels))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
