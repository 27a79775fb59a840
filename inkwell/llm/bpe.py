"""Byte-level BPE: encoding by recursive DuckDB queries in each partition, decoding by ordered aggregation.

A text is split by the tokenizer's pattern. The distinct pieces of a block become token-position rows
(piece, position, token) in an in-process DuckDB; a recursive query joins neighbouring tokens with the merge
table and contracts each piece's leftmost pair of least rank until no pair is in the table. As in the tiktoken
library, a piece that is itself a token starts as that one row. Ordered aggregation turns the last rows of a piece
into its id list and, through the vocabulary, back into bytes. As merging never crosses a piece and decoding never
crosses an id, a document's ids and bytes are the concatenation of its pieces'. A Python worker keeps pieces it has
met, up to CACHE_PIECES of them, so each block asks DuckDB only for new ones. No shuffle: one pass over the documents.

Contraction one pair at a time is quadratic in a piece's length, so pieces over SEGMENTED bytes are cut into segments
that the same queries encode, at joints that are proved: if the encoding of each two neighbouring segments
together has a token end at their joint, then no merge ever crosses a joint (the first that did would be the least
pair of those two segments as well, which their own encoding would have merged), and the segments' encodings put
together are the piece's. Joints start at unlikely byte pairs; one that fails goes, and its segments are one. In
stretches that repeat a short period, where the place of a joint depends on the start of the stretch, all later
joints move with the first that fails. Segments that grow beyond STEPWISE bytes take a recursive query that contracts
at one step all pairs of least rank that the one-at-a-time order would contract next; it stops at the first contraction
that makes a pair of the same or a lower rank, so the ids stay the same.
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import held, map_rows

#: Pieces that a worker remembers before it goes on with those of the present block (about 230 bytes each); the same for a frugal one.
CACHE_PIECES, FRUGAL_PIECES = 900_000, 150_000
#: Pieces in one recursive query (or ten times as many bytes); characters of texts that are split and encoded together.
BLOCK_PIECES, BLOCK_CHARS = 40_000, 4_000_000
#: Bytes cached at most; bytes from which a piece is cut into segments, and of a segment at first; bytes up to which
#: one pair is contracted at a time; periods that are looked for, and how many of them make a segment.
CACHE_BYTES, SEGMENTED, SEGMENT, STEPWISE, PERIODS, REPEATS = 60_000_000, 64, 16, 256, 16, 64

_RECURSION = """
WITH RECURSIVE s(done, piece, pos, tok) AS (
    SELECT false, piece, pos, tok FROM tokens
  UNION ALL (
    WITH pairs AS (
        SELECT piece, pos, tok, lead(tok) OVER w AS after, lead(pos) OVER w AS after_pos
        FROM s WHERE NOT done WINDOW w AS (PARTITION BY piece ORDER BY pos)),
    best AS (  -- least rank, then leftmost; packed as made, pos, after_pos
        SELECT piece, min(made * 4294967296 + pos::BIGINT * 65536 + after_pos) AS b
        FROM pairs JOIN merges ON merges.pair = pairs.tok * 65536::BIGINT + pairs.after GROUP BY piece)
    SELECT b IS NULL, pairs.piece, pairs.pos, CASE WHEN pairs.pos = (b >> 16) & 65535 THEN b >> 32 ELSE pairs.tok END
    FROM pairs LEFT JOIN best USING (piece) WHERE b IS NULL OR pairs.pos <> b & 65535))
"""

#: The same ids; a step contracts all of a piece's pairs of least rank, up to one that makes a pair to be contracted sooner.
_RANKWISE = """
WITH RECURSIVE s(done, piece, pos, tok) AS (
    SELECT false, piece, pos, tok FROM tokens
  UNION ALL (
    WITH pairs AS (
        SELECT piece, pos, tok, lead(tok) OVER w AS t1, lead(tok, 2) OVER w AS t2, lag(tok) OVER w AS t0, row_number() OVER w AS n
        FROM s WHERE NOT done WINDOW w AS (PARTITION BY piece ORDER BY pos)),
    ranked AS (SELECT pairs.*, made FROM pairs LEFT JOIN merges ON merges.pair = tok * 65536::BIGINT + t1),
    least AS (SELECT piece, min(made) AS r FROM ranked GROUP BY piece),
    hits AS (SELECT ranked.*, r, n - row_number() OVER (PARTITION BY piece ORDER BY n) AS run FROM ranked JOIN least USING (piece) WHERE made = r),
    taken AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY piece, run ORDER BY n) AS k FROM hits) WHERE k % 2 = 1),
    near AS (SELECT *, CASE WHEN lag(n) OVER (PARTITION BY piece ORDER BY n) = n - 2 THEN r ELSE t0 END AS before FROM taken),
    clash AS (
        SELECT piece, min(n) AS last FROM near
        LEFT JOIN merges a ON a.pair = before * 65536::BIGINT + r
        LEFT JOIN merges b ON b.pair = r * 65536::BIGINT + t2
        WHERE a.made <= r OR b.made <= r GROUP BY piece),
    used AS (SELECT piece, n FROM near LEFT JOIN clash USING (piece) WHERE last IS NULL OR n <= last)
    SELECT r IS NULL, piece, pos, CASE WHEN u.n IS NULL THEN tok ELSE r END
    FROM ranked JOIN least USING (piece) LEFT JOIN used u USING (piece, n)
    WHERE NOT EXISTS (SELECT 1 FROM used g WHERE g.piece = ranked.piece AND g.n = ranked.n - 1)))
"""

_IDS = "SELECT piece, list(tok ORDER BY pos) AS ids FROM s WHERE done GROUP BY piece ORDER BY piece"
_IDS_AND_TEXT = "SELECT piece, list(tok ORDER BY pos) AS ids, string_agg(chars, '' ORDER BY pos) AS text FROM s JOIN vocabulary ON id = tok WHERE done GROUP BY piece ORDER BY piece"


@dataclass(frozen=True)
class Vocabulary:
    """A rank file: tokens by id, and the split pattern."""

    tokens: tuple[bytes, ...]
    pattern: str

    @staticmethod
    def load(path: str, pattern: str) -> Vocabulary:
        """path: a file of lines `base64-token rank`, read on the driver only."""
        with open(path, "rb") as f:
            ranks = {int(b): base64.b64decode(a) for a, b in (line.split() for line in f if line.strip())}
        if sorted(ranks) != list(range(len(ranks))) or len(ranks) > 65536:
            raise ValueError("ranks must run from 0 and be at most 65536")
        return Vocabulary(tuple(ranks[i] for i in range(len(ranks))), pattern)


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> Vocabulary:
    """A vocabulary file of the box's public tokenizers."""
    import public_tokenizers

    return Vocabulary.load(public_tokenizers.path(name), public_tokenizers.PATTERN)


class Codec:
    """Encodes and decodes pieces with a DuckDB of its own; one lives in each Python worker."""

    def __init__(self, v: Vocabulary, cache_pieces: int = CACHE_PIECES, block_pieces: int = BLOCK_PIECES) -> None:
        import duckdb
        import regex

        self.cache_pieces, self.block_pieces = cache_pieces, block_pieces
        self.ids = {t: i for i, t in enumerate(v.tokens)}
        self.tokens = v.tokens
        self.split = regex.compile(v.pattern).findall
        self.packed: dict[str, bytes] = {}
        self.decoded: dict[bytes, bytes] = {}
        self.cached = 0
        self.byte_id = np.array([self.ids[bytes([b])] for b in range(256)], dtype=np.int64)
        self.size = np.array([len(t) for t in v.tokens], dtype=np.int64)
        #: Ranks of byte pairs; one that no token holds comes last.
        self.pair_rank = np.full(65536, 1 << 20)
        for t, i in self.ids.items():
            if len(t) == 2:
                self.pair_rank[t[0] * 256 + t[1]] = i
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "250MB", "temp_directory": ""})
        pair, made = [], []
        for t, rank in self.ids.items():
            for k in range(1, len(t)):
                a, b = self.ids.get(t[:k]), self.ids.get(t[k:])
                if a is not None and b is not None:
                    pair.append(a * 65536 + b)
                    made.append(rank)
        merges = pa.table({"pair": pa.array(pair, pa.int64()), "made": pa.array(made, pa.int64())})  # noqa: F841
        # A byte is kept as the character 256 + byte: DuckDB's strings then hold any bytes, without NUL.
        vocabulary = pa.table({"id": pa.array(range(len(v.tokens)), pa.int64()), "chars": ["".join(chr(256 + b) for b in t) for t in v.tokens]})  # noqa: F841
        self.db.execute("SET enable_progress_bar = false")
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges")
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary")

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces not met before."""
        if len(self.packed) > self.cache_pieces or self.cached > CACHE_BYTES:  # go on with the pieces in use
            self.packed = {p: self.packed[p] for p in pieces if p in self.packed}
            self.decoded = {x: self.decoded[x] for x in self.packed.values()}
            self.cached = sum(map(len, self.packed))
        new = [(p, p.encode()) for p in pieces if p not in self.packed]
        whole = [(p, b) for p, b in new if len(b) <= SEGMENTED or b in self.ids]
        long = [(p, b) for p, b in new if not (len(b) <= SEGMENTED or b in self.ids)]
        for block, ids, text in self._blocks([b for _, b in whole]):
            for k, i, t in zip(block, ids, text, strict=True):
                self._keep(whole[k][0], i, t)
        some: list[tuple[str, bytes]] = []
        size = 0
        for x in long:
            some.append(x)
            size += len(x[1])
            if size >= 10 * self.block_pieces:
                self._long(some)
                some, size = [], 0
        if some:
            self._long(some)

    def _keep(self, piece: str, packed: bytes, text: bytes) -> None:
        self.packed[piece] = packed
        self.decoded[packed] = text
        self.cached += len(piece)

    def _blocks(self, words: list[bytes], decode: bool = True):
        """Encode words, a block at a time: their numbers, packed ids (16 bits without decode) and, with decode, the bytes of those ids."""
        by_size = sorted(range(len(words)), key=lambda k: len(words[k]))
        block: list[int] = []
        weight = 0
        for at, k in enumerate(by_size):
            block.append(k)
            n = len(words[k])
            weight += 1 + n * min(n, STEPWISE) // 8  # rows of all steps
            last = at + 1 == len(by_size)
            if last or len(block) >= self.block_pieces or weight >= 8 * self.block_pieces or (n <= STEPWISE) != (len(words[by_size[at + 1]]) <= STEPWISE):
                yield block, *self._encoded([words[i] for i in block], decode, n > STEPWISE)
                block, weight = [], 0

    def _encoded(self, words: list[bytes], decode: bool, rankwise: bool) -> tuple[list[bytes], list[bytes]]:
        whole = [self.ids.get(b) if decode else None for b in words]
        sizes = np.array([len(b) if i is None else 1 for b, i in zip(words, whole, strict=True)])
        starts = np.cumsum(sizes) - sizes
        every = self.byte_id[np.frombuffer(b"".join(b if i is None else b"\0" for b, i in zip(words, whole, strict=True)), dtype=np.uint8)]
        for at, i in zip(starts.tolist(), whole, strict=True):
            if i is not None:
                every[at] = i
        tokens = pa.table({"piece": np.repeat(np.arange(len(words), dtype=np.int32), sizes), "pos": (np.arange(len(every)) - np.repeat(starts, sizes)).astype(np.int32), "tok": every})
        if grown := len(every) > 500_000:  # segments that could not be cut further
            self.db.execute(f"SET memory_limit = '{250 + len(every) // 2000}MB'")
        self.db.register("tokens", tokens)
        try:
            got = self.db.sql((_RANKWISE if rankwise else _RECURSION) + (_IDS_AND_TEXT if decode else _IDS)).to_arrow_table().combine_chunks()
        finally:
            self.db.unregister("tokens")
            if grown:
                self.db.execute("SET memory_limit = '250MB'")
        lists = got["ids"].chunk(0)
        width = 4 if decode else 2
        flat = lists.values.to_numpy().astype(f"<u{width}").tobytes()
        ends = (lists.offsets.to_numpy().astype(np.int64) * width).tolist()
        ids = [flat[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]
        return ids, [_bytes(t) for t in got["text"].to_pylist()] if decode else []

    def _long(self, pieces: list[tuple[str, bytes]]) -> None:
        """Encode long pieces by their segments."""
        every = b"".join(b for _, b in pieces)
        borders = np.cumsum([0] + [len(b) for _, b in pieces])
        cuts = self._joints(every, borders).tolist()
        segments = [every[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        number = {w: k for k, w in enumerate(dict.fromkeys(segments))}
        words = list(number)
        ids, text = [b""] * len(words), [b""] * len(words)
        for block, some_ids, some_text in self._blocks(words):
            for k, i, t in zip(block, some_ids, some_text, strict=True):
                ids[k], text[k] = i, t
        at = np.searchsorted(cuts, borders).tolist()
        for (p, _), i, j in zip(pieces, at[:-1], at[1:], strict=True):
            own = [number[w] for w in segments[i:j]]
            self._keep(p, b"".join(ids[k] for k in own), b"".join(text[k] for k in own))

    def _first_cuts(self, x: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places to cut at first, and for each the number of its periodic stretch (-1: none)."""
        n = len(x)
        rank = np.concatenate([[0], self.pair_rank[x[:-1].astype(np.int64) * 256 + x[1:]]])
        rank = np.concatenate([rank, np.full(-n % SEGMENT, -1)]).reshape(-1, SEGMENT)
        cuts = rank.argmax(axis=1) + np.arange(len(rank)) * SEGMENT
        zone = np.full(len(cuts), -1)
        free = np.ones(n + 1, dtype=bool)
        found = 0
        for p in range(1, PERIODS + 1):
            if n <= p:
                break
            same = np.concatenate([[0], (x[p:] == x[:-p]).astype(np.int8), [0]])
            same[borders[1:-1]] = 0  # a place between two pieces starts anew
            edge = np.diff(same)
            begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + p
            long = ends - begins >= 4 * REPEATS * p
            for i, j in zip(begins[long].tolist(), ends[long].tolist(), strict=True):
                if not free[i:j].all():
                    continue
                free[i:j] = False
                own = np.arange(i + REPEATS * p, j - REPEATS * p // 2, REPEATS * p)
                out = (cuts >= i) & (cuts < j)
                cuts, zone = np.concatenate([cuts[~out], own]), np.concatenate([zone[~out], np.full(len(own), found)])
                found += 1
        keep = (cuts > 0) & (cuts < n) & ~np.isin(cuts, borders)
        cuts, zone = np.concatenate([cuts[keep], borders]), np.concatenate([zone[keep], np.full(len(borders), -2)])
        order = np.argsort(cuts, kind="stable")
        return cuts[order], zone[order]

    def _joints(self, every: bytes, borders: np.ndarray) -> np.ndarray:
        """Places to cut at, borders included, at each of which the encoding of its two segments together has a token end."""
        x = np.frombuffer(every, dtype=np.uint8)
        cuts, zone = self._first_cuts(x, borders)
        proved = zone == -2
        turn = 0
        while not proved.all():
            turn += 1
            open_ = np.flatnonzero(~proved)
            left, here, right = cuts[open_ - 1], cuts[open_], cuts[open_ + 1]
            number: dict[bytes, int] = {}
            which = np.array([number.setdefault(every[i:j], len(number)) for i, j in zip(left.tolist(), right.tolist(), strict=True)])
            words = list(number)
            ids = [b""] * len(words)
            for block, some, _ in self._blocks(words, decode=False):
                for k, i in zip(block, some, strict=True):
                    ids[k] = i
            count = np.array([len(i) // 2 for i in ids])
            ends = np.cumsum(self.size[np.frombuffer(b"".join(ids), dtype="<u2")])  # of all words, one behind the other
            first = np.cumsum([len(w) for w in words]) - [len(w) for w in words]
            place = first[which] + here - left
            at = np.searchsorted(ends, place)
            good = ends[at] == place
            proved[open_[good]] = True
            gone = np.zeros(len(cuts), dtype=bool)
            moved: set[int] = set()
            for k in np.flatnonzero(~good).tolist():
                i = int(open_[k])
                if gone[i]:
                    continue
                z = int(zone[i])
                if z >= 0 and z in moved:
                    continue
                w = int(which[k])
                token_ends = ends[count[:w].sum() : count[: w + 1].sum()][:-1] - first[w] if z >= 0 else []
                if z >= 0 and turn <= 6 and len(token_ends):
                    moved.add(z)
                    by = int(token_ends[np.abs(token_ends - (here[k] - left[k])).argmin()] - (here[k] - left[k]))
                    later = np.flatnonzero((zone == z) & (np.arange(len(cuts)) >= i))
                    cuts[later] += by
                    proved[later] = False
                else:
                    reach = SEGMENT << turn if turn > 2 else 0
                    near = np.arange(np.searchsorted(cuts, cuts[i] - reach), np.searchsorted(cuts, cuts[i] + reach, side="right"))
                    gone[near[zone[near] != -2]] = True
            # moved places that are no longer in order go as well
            highest = np.maximum.accumulate(np.concatenate([[-1], cuts[:-1]]))
            gone |= (cuts <= highest) & (zone != -2)
            lowest = np.minimum.accumulate(np.concatenate([cuts[1:], [len(every) + 1]])[::-1])[::-1]
            gone |= (cuts >= lowest) & (zone != -2)
            beside = np.flatnonzero(gone)
            for d in (-1, 1):
                there = np.clip(beside + d, 0, len(cuts) - 1)
                while (back := gone[there]).any():
                    there = np.where(back, np.clip(there + d, 0, len(cuts) - 1), there)
                proved[there[zone[there] != -2]] = False
            for z in moved:  # the places beside moved ones are to be proved anew
                own = np.flatnonzero((zone == z) & ~gone)
                for there in np.clip([own.min() - 1, own.max() + 1], 0, len(cuts) - 1) if len(own) else []:
                    if zone[there] != -2:
                        proved[there] = False
            cuts, zone, proved = cuts[~gone], zone[~gone], proved[~gone]
        return cuts

    def _decode(self, ids: list[int]) -> bytes:
        out = []
        for at in range(0, len(ids), 100_000):
            some = ids[at : at + 100_000]
            ids_in = pa.table({"pos": np.arange(len(some)), "tok": np.asarray(some, dtype=np.int64)})  # noqa: F841
            out.append(_bytes(self.db.execute("SELECT string_agg(chars, '' ORDER BY pos) FROM ids_in JOIN vocabulary ON id = tok").fetchall()[0][0] or ""))
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[list[bytes]]:
        """Packed ids of each text's pieces; the texts should be a block's worth."""
        split = [self.split(t) for t in texts]
        self.learn(set().union(*split) if split else set())
        return [list(map(self.packed.__getitem__, s)) for s in split]

    def decode(self, pieces: list[bytes]) -> bytes:
        """The bytes of the packed ids of pieces that `encode` has just returned."""
        return b"".join(map(self.decoded.__getitem__, pieces))


def _bytes(chars: str) -> bytes:
    """The bytes kept as characters 256 + byte: the low halves of the UTF-16 units."""
    return chars.encode("utf-16-le")[::2]


def _blocks(texts: list[str], chars: int = BLOCK_CHARS):
    block, size = [], 0
    for t in texts:
        block.append(t)
        size += len(t)
        if size >= chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def _codec(shared, frugal: bool = False) -> Codec:
    """This worker's codec of a broadcast vocabulary."""
    v = shared.value
    how = (FRUGAL_PIECES, BLOCK_PIECES // 2) if frugal else (CACHE_PIECES, BLOCK_PIECES)
    return held(f"bpe {hash((v.pattern, len(v.tokens), v.tokens[-64:], frugal))}", lambda: Codec(v, *how))


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False, frugal: bool = False) -> DataFrame:
    """Encode every whole text, then decode the ids.

    Returns, for each row: the id column, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit
    integers), decoded_sha256 (of the decoded bytes) and, with_ids, ids (those bytes). A null text counts as
    empty: 0 tokens and the hash of no bytes. Repeated rows are encoded each; a null id stays null; an
    empty table gives an empty one; other columns of docs are ignored. frugal: blocks and caches of half the size
    and less, for workers that share their memory with other work; somewhat slower, the same result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # under 1 MB: at most 65536 tokens
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.binary())] * with_ids)

    def run(b: dict[str, list]) -> dict[str, list]:
        codec = _codec(shared, frugal)
        out: dict[str, list] = {f.name: [] for f in schema}
        out["id"] = b["id"]
        for block in _blocks([t or "" for t in b["text"]], BLOCK_CHARS // 4 if frugal else BLOCK_CHARS):
            for pieces in codec.encode(block):
                ids = b"".join(pieces)
                out["n_tokens"].append(len(ids) // 4)
                out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(codec.decode(pieces)).hexdigest())
                if with_ids:
                    out["ids"].append(ids)
        return out

    return map_rows(docs, {"id": F.col(id_column).cast("long"), "text": F.col(text_column).cast("string")}, run, schema).withColumnRenamed("id", id_column)


def decode_documents(encoded: DataFrame, vocabulary: Vocabulary, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """The text of each row's packed ids, by ordered aggregation: id column, text (bytes that are no UTF-8 are replaced; null ids give the empty text)."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    schema = pa.schema([("id", pa.int64()), ("text", pa.string())])

    def run(b: dict[str, list]) -> dict[str, list]:
        codec = _codec(shared)
        return {"id": b["id"], "text": [codec._decode(np.frombuffer(x or b"", dtype="<u4").tolist()).decode("utf-8", "replace") for x in b["ids"]]}

    return map_rows(encoded, {"id": F.col(id_column).cast("long"), "ids": F.col(ids_column)}, run, schema).withColumnRenamed("id", id_column)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the 50k byte-level vocabulary."""
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_vocabulary())
