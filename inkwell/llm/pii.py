"""Personal data by weak supervision.

Base spans (e-mail, IP address, payment card, phone) follow fixed patterns and always stay. Further candidates
(social-security and bank numbers, national phone numbers, hardware addresses, spelled-out e-mails, names and
birth dates) come from looser patterns. Labelers of three sorts vote on every candidate, base ones included:
patterns and check digits, gazetteers, and context words, each for (+), against (-) or silent (0). The counts of vote
patterns over all documents feed an expectation-maximisation that estimates how often each labeler's votes are
right (one half at least, so true and false can't change places; the start counts as START_VOTES votes, whatever the
number of documents); its posteriors, with the counts of feature patterns, train a logistic span classifier. A candidate
that is no base span becomes one of the method's spans if the classifier gives it THRESHOLD or more and it overlaps
no base span.

One pass reads the texts; only counts of patterns (a bounded number of kinds, votes and features) come together.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import cut, map_rows, sigmoid

BASE = ("email", "ip", "card", "phone")
MORE = ("email_words", "ssn", "iban", "phone_national", "mac", "name", "birth_date")
KINDS = BASE + MORE
#: Characters around a candidate in which context labelers look.
CONTEXT = 48
LABELERS, THRESHOLD, ROUNDS = 5, 0.6, 200
#: Votes that the start counts as, whatever the number of documents; weight of all counted patterns in the classifier.
START_VOTES, PATTERN_WEIGHT = 20.0, 10_000.0

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Given names, titles, context words.
GIVEN = set("james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen maria anna hans peter klaus ursula wolfgang monika jean pierre marie jacques isabelle jose carmen juan pablo lucia antonio".split())
_LOOSE = {
    "email_words": re.compile(r"\b[A-Za-z0-9._+-]{1,64} ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z]{2,24}){1,3}\b"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "phone_national": re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ -])[0-9]{3}-[0-9]{4}(?![0-9-])"),
    "mac": re.compile(r"\b(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}\b"),
    "name": re.compile(r"\b(?:(?:Mr|Mrs|Ms|Dr)\.?|[Nn]ame is) ([A-Z][a-z]{1,20} [A-Z][a-z]{1,20})\b"),
    "birth_date": re.compile(r"\b(?:born(?: on)?|birth ?date:?|date of birth:?|dob:?) ([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})\b", re.I),
}
#: The usual written form of each kind; looser ones get no vote from the first labeler.
_STRICT = {
    "email": re.compile(r".*\.[A-Za-z]{2,24}", re.S), "ip": re.compile(r"(?:0|[1-9][0-9]*)(?:\.(?:0|[1-9][0-9]*)){3}"), "card": re.compile(r"[0-9]{16,19}|[0-9]{4}(?:[ -][0-9]{4}){3}"),
    "phone": re.compile(r"\+[1-9][0-9]{0,2}[ .-]?\(?[0-9].*", re.S), "email_words": re.compile(r".*[\[(]at[\])].*[\[(]dot[\])].*", re.S), "ssn": re.compile(r"[0-8][0-9]{2}-[0-9]{2}-[0-9]{4}"),
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4})+(?: [A-Z0-9]{1,3})?"), "phone_national": re.compile(r"\([2-9][0-9]{2}\) [2-9][0-9]{2}-[0-9]{4}"), "mac": re.compile(r"[0-9a-f:]+|[0-9A-F:]+"),
    "name": re.compile(r"[A-Z][a-z]{2,} [A-Z][a-z]{2,}"), "birth_date": re.compile(r"(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]"),
}
_NEAR = {
    "email": "mail email contact write address", "email_words": "mail email contact write address", "ip": "ip host server client address login", "card": "card visa mastercard payment credit",
    "phone": "phone tel call mobile fax contact", "phone_national": "phone tel call mobile fax contact", "ssn": "ssn social security", "iban": "iban bank account transfer", "mac": "mac hardware device ethernet",
    "name": "name mr mrs ms dr dear", "birth_date": "born birth dob birthday",
}
#: Where EM starts: how often a vote of each labeler (strict pattern, check, gazetteer, context for, context against) is right.
START = np.array([0.6, 0.65, 0.75, 0.8, 0.95])
_NEAR_SETS = {k: set(v.split()) for k, v in _NEAR.items()}
_AGAINST = set("version isbn part sku serial order item model revision build example page chapter".split())
_BANK_COUNTRIES = set("AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK TR".split())
_DOMAINS = set("com org net edu gov de fr es it uk eu io info co".split())
_WORDS = re.compile(r"[a-z]+")


def _luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[0::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def _iban(value: str) -> bool:
    v = value.replace(" ", "")
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern, found from each @, so that long runs without one cost nothing."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind, then start; matches that fail their check are dropped."""
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def loose_spans(text: str) -> list[tuple[str, int, int]]:
    """Candidates beyond the base patterns."""
    out = []
    for kind, pattern in _LOOSE.items():
        for m in pattern.finditer(text):
            g = m.lastindex or 0
            out.append((kind, *m.span(g)))
    return out


def _check(kind: str, value: str) -> int:
    """Patterns and check digits."""
    if kind == "iban":
        return 1 if _iban(value) else -1
    if kind == "ssn":
        a, b, c = value.split("-")
        return -1 if a in ("000", "666") or a[0] == "9" or b == "00" or c == "0000" else 1
    if kind == "card":
        return 1 if value[0] in "3456" else -1
    if kind == "ip":
        return -1 if value.startswith(("0.", "127.", "255.")) else 1
    if kind in ("phone", "phone_national"):
        return -1 if len({c for c in value if c.isdigit()}) < 3 else 1
    if kind == "mac":
        return -1 if len(set(value.lower())) <= 3 else 1
    if kind == "birth_date":
        y = int(re.search(r"[0-9]{4}", value).group())
        return 1 if 1900 <= y <= 2025 else -1
    return 0


def _gazetteer(kind: str, value: str) -> int:
    if kind in ("email", "email_words"):
        return 1 if re.split(r"[^A-Za-z]+", value)[-1].lower() in _DOMAINS else -1
    if kind == "iban":
        return 1 if value[:2] in _BANK_COUNTRIES else -1
    if kind == "name":
        return 1 if value.split()[0].lower() in GIVEN else 0
    return 0


def votes(kind: str, value: str, around: str) -> tuple[int, ...]:
    """Strict pattern, check, gazetteer, context for, context against."""
    words = set(_WORDS.findall(around.lower()))
    return 1 if _STRICT[kind].fullmatch(value) else 0, _check(kind, value), _gazetteer(kind, value), 1 if words & _NEAR_SETS[kind] else 0, -1 if words & _AGAINST else 0


def span_features(kind: str, value: str, before: str) -> tuple[int, ...]:
    """Small integers that describe a span: kind, length, digits, separators, case, what stands before."""
    digits = sum(c.isdigit() for c in value)
    return KINDS.index(kind), min(4, len(value) // 8), min(3, 4 * digits // max(1, len(value))), min(3, sum(not c.isalnum() for c in value)), int(value[:1].isupper()), int(before[-1:] in "=:("), int(len(set(value)) < 4)


def candidates(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, pattern) of base and loose spans; pattern: votes and features as text."""
    out = []
    for kind, s, e in base_spans(text) + loose_spans(text):
        value, before, after = text[s:e], text[max(0, s - CONTEXT) : s], text[e : e + CONTEXT]
        v, f = votes(kind, value, before + " " + after), span_features(kind, value, before)
        out.append((kind, s, e, ",".join(map(str, v)) + ";" + ",".join(map(str, f))))
    return out


@dataclass(frozen=True)
class LabelModel:
    """What EM finds: for each kind its share of true spans, for each labeler the share of its votes that are right."""

    prior: dict[int, float]
    right: np.ndarray

    def posterior(self, kind: int, v: np.ndarray) -> float:
        p = self.prior.get(kind, 0.5)
        return float(sigmoid(np.log(p / (1 - p)) + v @ np.log(self.right / (1 - self.right))))


def fit_labels(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = ROUNDS) -> LabelModel:
    """EM over (kind, votes, count). A silent labeler says nothing; one that votes is right at least half of the time."""
    if not patterns:
        return LabelModel({}, START)
    kinds = sorted({k for k, _, _ in patterns})
    kind = np.array([kinds.index(k) for k, _, _ in patterns])
    v = np.array([x for _, x, _ in patterns], dtype=np.float64)
    n = np.array([float(c) for *_, c in patterns])
    prior, right = np.full(len(kinds), 0.5), START
    for _ in range(rounds):
        p = sigmoid(np.log(prior / (1 - prior))[kind] + v @ np.log(right / (1 - right)))
        agree = np.where(v > 0, p[:, None], 1 - p[:, None]) * (v != 0)
        new = (START * START_VOTES + n @ agree) / (START_VOTES + n @ (v != 0))
        new = np.clip(new, 0.5, 0.999)
        prior = (2 + np.bincount(kind, weights=n * p)) / (4 + np.bincount(kind, weights=n))
        done = np.abs(new - right).max() < 1e-9
        right = new
        if done:
            break
    return LabelModel(dict(zip(kinds, prior.tolist(), strict=True)), right)


def _vector(f: tuple[int, ...], v: tuple[int, ...]) -> np.ndarray:
    x = np.zeros(1 + len(KINDS) + 5 + 4 + 4 + 3 + 3 * LABELERS)
    x[0] = 1
    x[1 + f[0]] = 1
    at = 1 + len(KINDS)
    for value, room in ((f[1], 5), (f[2], 4), (f[3], 4)):
        x[at + value] = 1
        at += room
    x[at : at + 3] = f[4:7]
    at += 3
    for i, k in enumerate(v):
        x[at + 3 * i + k + 1] = 1
    return x


@dataclass(frozen=True)
class SpanModel:
    """The final classifier and the label model it learned from."""

    weights: np.ndarray
    labels: LabelModel

    def probability(self, pattern: str) -> float:
        v, f = _parse(pattern)
        return float(sigmoid(_vector(f, v) @ self.weights))


def _parse(pattern: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
    a, b = pattern.split(";")
    return tuple(map(int, a.split(","))), tuple(map(int, b.split(",")))


def train(counts: dict[str, int]) -> SpanModel:
    """counts: how often each pattern occurs over all documents."""
    rows = [(*_parse(p), n) for p, n in sorted(counts.items())]
    by: dict[tuple[int, tuple[int, ...]], int] = {}
    for v, f, n in rows:
        by[f[0], v] = by.get((f[0], v), 0) + n
    labels = fit_labels([(k, v, n) for (k, v), n in sorted(by.items())])
    # One made-up row for each kind and vote, of weight 1, holds the classifier to the label model where data are few.
    some = [((w, c, g, a, b), (k, 1, 1, 1, 0, 0, 0), 1) for k in range(len(KINDS)) for w in (0, 1) for c in (-1, 0, 1) for g in (-1, 0, 1) for a in (0, 1) for b in (-1, 0)]
    data = rows + some
    x = np.array([_vector(f, v) for v, f, _ in data])
    total = max(1, sum(c for *_, c in rows))
    n = np.array([c * PATTERN_WEIGHT / total for *_, c in rows] + [1.0] * len(some))
    y = np.array([labels.posterior(f[0], np.array(v)) for v, f, _ in data])
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = sigmoid(x @ w)
        h = (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (n * (p - y)) + 0.1 * w)
        w = w - step / max(1.0, np.abs(step).max() / 4)
    return SpanModel(w, labels)


def find(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, base_confidence for each row.

    n_*, base_sha256: the base spans. spans: all spans as kind:start:end (code points, end exclusive), comma-joined
    by kind as in KINDS, then start; n_added counts those the method adds; base_confidence is the classifier's least
    probability of a base span (null without one). A null text counts as empty; a null id stays null; repeated rows
    are searched each; an empty table gives an empty one; other columns are ignored.
    """
    import hashlib

    first = pa.schema([("id", pa.int64()), ("base", pa.list_(pa.string())), ("loose", pa.list_(pa.string()))])

    def search(b: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"id": b["id"], "base": [], "loose": []}
        for t in b["text"]:
            c = candidates(t or "")
            out["base"].append([f"{k}:{s}:{e}|{p}" for k, s, e, p in c if k in BASE])
            out["loose"].append([f"{k}:{s}:{e}|{p}" for k, s, e, p in c if k not in BASE])
        return out

    found = cut(map_rows(docs, {"id": F.col(f"`{id_column}`").cast("long"), "text": F.col(f"`{text_column}`").cast("string")}, search, first))
    patterns = found.select(F.explode(F.concat("base", "loose")).alias("x")).select(F.substring_index("x", "|", -1).alias("p"))
    # at most kinds x votes x features patterns, whatever the input
    model = train({r["p"]: r["n"] for r in patterns.groupBy("p").agg(F.count("*").alias("n")).collect()})

    last = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in BASE], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64()), ("base_confidence", pa.float64())])
    known: dict[str, float] = {}

    def sure(p: str) -> float:
        if p not in known:
            known[p] = model.probability(p)
        return known[p]

    def decide(b: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {f.name: [] for f in last}
        out["doc_id"] = b["id"]
        for base, loose in zip(b["base"], b["loose"], strict=True):
            spans = [x.split("|")[0] for x in base]
            taken = [tuple(map(int, x.split(":")[1:])) for x in spans]
            added = []
            for x in loose:
                span, p = x.split("|")
                s, e = map(int, span.split(":")[1:])
                if sure(p) >= threshold and all(e <= a or s >= z for a, z in taken):
                    added.append(span)
                    taken.append((s, e))
            for k in BASE:
                out[f"n_{k}"].append(sum(x.startswith(k + ":") for x in spans))
            out["base_sha256"].append(hashlib.sha256(",".join(spans).encode()).hexdigest())
            out["spans"].append(",".join(spans + added))
            out["n_added"].append(len(added))
            out["base_confidence"].append(min((sure(x.split("|")[1]) for x in base), default=None))
        return out

    return map_rows(found, {"id": "id", "base": "base", "loose": "loose"}, decide, last)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data in every document."""
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
