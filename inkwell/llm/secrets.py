"""Secret scans with a random forest that removes false positives.

Candidates are long tokens with letters and digits, tokens with the prefix of a known key format and values
assigned to a telling name, of any length. The forest sees a candidate's length, character transitions, entropy and classes, how
much of it common words and letter pairs cover, the path it stands in and the words before it. It is trained on
labelled findings: a table of (line, value, path, is_secret) or, by default, a seeded set generated from key
formats and from look-alikes (hashes in commit lines, identifiers, versions, placeholders).
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import map_rows

#: Trees, depth and seed of the forest; findings that are generated; probability from which a finding counts.
TREES, DEPTH, SEED, GENERATED, THRESHOLD = 40, 9, 17, 4000, 0.5
#: Characters in front of a candidate in which its neighbouring words and path are looked for.
CONTEXT = 80

_NAMES = r"pass(?:word|wd|phrase)?|secret|token|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key"
#: A name with what sets its value, each run of name characters read once; the value; a token that stands alone. All are linear in the text.
_SETS = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z0-9_.-]++)[\"']?\s*+(?::=|=>|=|:)\s*+")
_NAMED = re.compile(rf"(?i:{_NAMES})")
_VALUE = re.compile(r"\"[^\"\s]{6,}+\"|'[^'\s]{6,}+'|[^\s\"',;]{6,}+")
_BARE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+")
_PATH = re.compile(r"(?:[A-Za-z0-9_.-]++/)++[A-Za-z0-9_-]++\.[A-Za-z0-9]{1,10}|[A-Za-z0-9_-]++\.(?:env|pem|cfg|ini|ya?ml|json|properties|py|md|txt)\b")
_PREFIX = re.compile(r"^(?:AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|sk_live_|rk_live_|xox[abprs]-|AIza|ya29\.|eyJ|SG\.|npm_|pypi-)")
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
# Frequent words and letter pairs of prose and code.
_WORDS = "the and for with that this from have not are was will your you key name test value data file user example change here null none true false password secret token default sample config string number version build commit model report index table order item".split()
_PAIRS = set("th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce".split())
_GOOD_WORDS = set("key token secret password passwd pwd auth credential credentials bearer access private aws api login".split())
_BAD_WORDS = set("commit sha sha1 sha256 md5 checksum hash uuid guid id version build revision digest etag blob tree example sample placeholder image".split())


def features(value: str, before: str, path: str, assigned: bool) -> list[float]:
    """What the forest sees of a candidate; before: the text in front of it."""
    n = len(value)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in value]
    counts = Counter(value)
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    low = value.lower()
    covered = [False] * n
    for w in _WORDS:
        at = low.find(w)
        while at >= 0:
            covered[at : at + len(w)] = [True] * len(w)
            at = low.find(w, at + 1)
    pairs = sum(low[i : i + 2] in _PAIRS for i in range(n - 1))
    words = re.findall(r"[a-z0-9]+", before.lower())[-4:]
    path = path.lower()
    return [
        float(min(n, 100)), sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1), entropy, entropy / max(1.0, math.log2(n)),
        kinds.count("d") / n, kinds.count("u") / n, kinds.count("o") / n, sum(covered) / n, pairs / max(1, n - 1), len(counts) / n,
        float(all(c in string.hexdigits for c in value)), float(bool(_PREFIX.match(value))), float(assigned),
        float(any(w in _GOOD_WORDS for w in words)), float(any(w in _BAD_WORDS for w in words)),
        float(bool(re.search(r"test|example|sample|fixture|doc", path))), float(bool(re.search(r"\.(env|pem|cfg|ini|ya?ml|json|properties)$", path))),
        float(bool(re.fullmatch(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}", value))),
    ]


def _assigned(text: str) -> list[tuple[int, int, int]]:
    """(start of the name, start, end) of the values assigned to telling names, left to right, none within another."""
    out, floor = [], 0
    for m in _SETS.finditer(text):
        # the part behind the last dot is the name, as in settings.api_key
        if m.start() < floor or not _NAMED.search(m.group(1).rsplit(".", 1)[-1]):
            continue
        v = _VALUE.match(text, m.end())
        if not v:
            continue
        start, end = v.span()
        if text[start] in "\"'":
            start, end = start + 1, end - 1
        else:
            end = start + len(text[start:end].rstrip(".)]}"))
        floor = v.end()
        if end - start >= 6:
            out.append((m.start(), start, end))
    return out


def candidates(text: str) -> list[tuple[int, int, str, str, bool]]:
    """(start, end, value, text before, assigned) of each candidate, left to right.

    The text before is the CONTEXT characters in front; the name of an assigned value counts among its words.
    """
    named = _assigned(text)
    out = [(s, e, text[s:e], text[max(0, s - CONTEXT) : s], True) for _, s, e in named]
    at = 0
    for m in _BARE.finditer(text):
        s, e = m.span()
        while at < len(named) and named[at][2] <= s:
            at += 1
        if at < len(named) and named[at][0] < e:
            continue  # part of an assignment
        if _DIGIT.search(text, s, e) and _LETTER.search(text, s, e):
            out.append((s, e, text[s:e], text[max(0, s - CONTEXT) : s], False))
    return sorted(out)


def path_before(before: str) -> str:
    """The last file path in the text before a candidate, for texts without a path of their own."""
    return (_PATH.findall(before) or [""])[-1]


def generated_findings(n: int = GENERATED, seed: int = SEED) -> list[tuple[str, str, str, int]]:
    """Labelled findings (text before, value, path, is_secret) made from key formats and look-alikes."""
    r = random.Random(seed)
    pick = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    an, hexa, b64 = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "+/"
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(2, 4)))
    secret = [
        lambda: ("", "AKIA" + pick(string.ascii_uppercase + "234567", 16)),
        lambda: (r.choice(["password=", "db_password: ", "passwd = "]), pick(hexa, r.randint(12, 24))),
        lambda: (r.choice(["token = \"", "auth_token: ", "api_key='", "secret="]), pick(hexa, r.choice([32, 40, 64]))),
        lambda: (r.choice(["token = \"", "access_key=", "api_key: "]), pick(an, r.randint(20, 44))),
        lambda: ("", "ghp_" + pick(an, 36)),
        lambda: ("", "sk_live_" + pick(an, 24)),
        lambda: ("", "xoxb-" + pick("0123456789", 12) + "-" + pick(an, 24)),
        lambda: (r.choice(["aws_secret_access_key = ", "secret: ", ""]), pick(b64, 40)),
        lambda: (r.choice(["password=", "pwd: password = "]), word() + pick("!$%&?", 1) + pick("0123456789", 3) + word().upper()),
        lambda: ("bearer token: ", "eyJ" + pick(an, 50)),
    ]
    other = [
        lambda: (r.choice(["commit ", "sha1 ", "checksum: ", "tree ", "digest "]), pick(hexa, r.choice([32, 40, 64]))),
        lambda: (r.choice(["uuid ", "id ", "request id: ", ""]), "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12))),
        lambda: ("", "_".join(word() for _ in range(r.randint(3, 5))) + pick("0123456789", r.randint(1, 2))),
        lambda: ("", "-".join(word() for _ in range(r.randint(3, 5))) + "-" + pick("0123456789", r.randint(1, 4))),
        lambda: ("password=", r.choice(["changeme", "password", "your_password", "example123", "<password>", "${PASSWORD}", "xxxxxxxx", "None", "********"])),
        lambda: (r.choice(["token: ", "api_key=", "secret = "]), r.choice(["your_api_key_here", "YOUR-TOKEN-HERE", "test_token_value", "example_secret_1", "os.environ", "None", "config.token", "get_token()"])),
        lambda: ("", "/".join(word() for _ in range(r.randint(3, 5))) + "/" + word() + pick("0123456789", 2)),
        lambda: ("version ", "v" + pick("0123456789", 2) + "-build-" + pick("0123456789", 8)),
        lambda: ("order id ", pick("0123456789", 12) + "-" + word() + "-" + pick("0123456789", 4)),
        lambda: ("", word() + word() + word() + word() + pick("0123456789", r.randint(1, 2))),
    ]
    out = []
    for i in range(n):
        y = i % 2
        before, value = r.choice(secret if y else other)()
        lead = " ".join(word() for _ in range(r.randint(0, 4)))
        out.append((f"{lead} {before}", value, r.choice(["", "", "", "src/app.py", "config/prod.env", "docs/example.md", "tests/test_app.py"]), y))
    return out


@dataclass
class Forest:
    """Trees as flat arrays (feature, threshold, left, right, probability)."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, right, p in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH + 1):
                inner = feature[at] >= 0
                if not inner.any():
                    break
                go = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            total += p[at]
        return total / max(1, len(self.trees))


def _split(x: np.ndarray, y: np.ndarray, columns: np.ndarray) -> tuple[float, int, float]:
    """The best (weighted Gini impurity, column, threshold)."""
    best = (1e9, -1, 0.0)
    n = len(y)
    for c in columns:
        order = np.argsort(x[:, c], kind="stable")
        v, k = x[order, c], np.cumsum(y[order])
        at = np.flatnonzero(v[1:] > v[:-1])
        if not len(at):
            continue
        nl = at + 1.0
        pl, pr = k[at] / nl, (k[-1] - k[at]) / (n - nl)
        g = (nl * pl * (1 - pl) + (n - nl) * pr * (1 - pr)) / n
        i = int(g.argmin())
        if g[i] < best[0]:
            best = (float(g[i]), int(c), float((v[at[i]] + v[at[i] + 1]) / 2))
    return best


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> Forest:
    """Bootstrap rows for each tree, a random square root of the features for each split."""
    rng = np.random.default_rng(seed)
    width = max(1, int(math.sqrt(x.shape[1])))
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        nodes: list[list[float]] = []
        stack = [(rows, 0, -1, 0)]
        while stack:
            r, d, parent, side = stack.pop()
            me = len(nodes)
            if parent >= 0:
                nodes[parent][2 + side] = me
            nodes.append([-1, 0.0, 0, 0, float(y[r].mean())])
            if d >= depth or len(r) < 6 or y[r].min() == y[r].max():
                continue
            _, c, t = _split(x[r], y[r], rng.choice(x.shape[1], width, replace=False))
            if c < 0:
                continue
            nodes[me][:2] = [c, t]
            go = x[r, c] <= t
            stack += [(r[go], d + 1, me, 0), (r[~go], d + 1, me, 1)]
        a = np.array(nodes)
        out.append((a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4]))
    return Forest(out)


def train(findings: list[tuple[str, str, str, int]] | None = None) -> Forest:
    """A forest from labelled findings (text before, value, path, is_secret)."""
    rows = generated_findings() if findings is None else findings
    assigned = re.compile(rf"(?i:(?:{_NAMES})[a-z0-9_-]*[\"']?\s*(?::=|=>|=|:)\s*[\"']?)$")
    x = np.array([features(v, b, p, bool(assigned.search(b))) for b, v, p, _ in rows])
    return fit_forest(x, np.array([float(r[3]) for r in rows]))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path_column: str | None = None, forest: Forest | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_candidates, n_secrets, max_score, spans (start:end of the secrets in code points, comma-joined) for each row.

    The path is that of path_column or, without one, the last one named in front of a candidate.
    A null or empty text has no candidates and a max_score of 0; a null id stays null; repeated rows are scanned
    each; an empty table gives an empty one; other columns are ignored.
    """
    forest = forest or train()
    schema = pa.schema([("doc_id", pa.int64()), ("n_candidates", pa.int64()), ("n_secrets", pa.int64()), ("max_score", pa.float64()), ("spans", pa.string())])

    def run(b: dict[str, list]) -> dict[str, list]:
        found = [candidates(t or "") for t in b["text"]]
        flat = [features(v, before, path or path_before(before), a) for cs, path in zip(found, b["path"], strict=True) for _, _, v, before, a in cs]
        p = forest.probability(np.array(flat)) if flat else np.empty(0)
        out: dict[str, list] = {"doc_id": b["id"], "n_candidates": [len(c) for c in found], "n_secrets": [], "max_score": [], "spans": []}
        at = 0
        for cs in found:
            own = p[at : at + len(cs)]
            at += len(cs)
            hits = [f"{c[0]}:{c[1]}" for c, q in zip(cs, own, strict=True) if q >= threshold]
            out["n_secrets"].append(len(hits))
            out["max_score"].append(float(own.max()) if len(own) else 0.0)
            out["spans"].append(",".join(hits))
        return out

    path = F.col(f"`{path_column}`").cast("string") if path_column else F.lit("")
    return map_rows(docs, {"id": F.col(f"`{id_column}`").cast("long"), "text": F.col(f"`{text_column}`").cast("string"), "path": path}, run, schema)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets in every document."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
