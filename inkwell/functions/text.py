"""Text functions as Spark columns: tokens, stems, hashes, highlights, intents."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import domain as D


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def stem_sql(word: str) -> str:
    """The suffix rules as one CASE expression that Spark and DuckDB both read."""
    rules = " ".join(f"WHEN {word} LIKE '%{s}' AND length({word}) > {len(s) + 2} THEN concat(left({word}, length({word}) - {len(s)}), '{r}')" for s, r in D.SUFFIXES)
    return f"CASE {rules} ELSE {word} END"


def stem(word: Column) -> Column:
    """The first suffix rule that fits, as one codegen-able CASE."""
    hit = lambda s: word.endswith(s) & (F.length(word) > len(s) + 2)
    cut = lambda s, r: F.concat(F.substring(word, F.lit(1), F.length(word) - len(s)), F.lit(r))
    out = F.when(hit(D.SUFFIXES[0][0]), cut(*D.SUFFIXES[0]))
    for s, r in D.SUFFIXES[1:]:
        out = out.when(hit(s), cut(s, r))
    return out.otherwise(word)


def cleaned(text: Column) -> Column:
    """In lower case; anything but letters, digits, underscores and white space becomes a space."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " ")


#: What `cleaned` replaces of the characters below U+0250 and from U+2000 to U+206F, as Arrow's regular expression.
REPLACED = r"[\x00-\x08\x0E-\x1F!-/:-@\[-\^`{-\x{A9}\x{AB}-\x{B1}\x{B4}\x{B6}-\x{B8}\x{BB}\x{BF}\x{D7}\x{F7}\x{2000}-\x{206F}]+"


def lowered(text: Column) -> Column:
    """In lower case, and `cleaned` if it holds characters that REPLACED does not judge: without REPLACED and split at white space it has the same words as `cleaned`."""
    low = F.lower(text)
    return F.when(low.rlike(r"[^\x00-\x{24F}\x{2000}-\x{206F}]"), cleaned(text)).otherwise(low)


def raw_tokens(text: Column) -> Column:
    """Lower-case words of two letters or more; anything but letters, digits, underscores and white space separates."""
    return F.filter(F.split(cleaned(text), r"\s+"), lambda t: F.length(t) >= 2)


def words(text: Column) -> Column:
    """raw_tokens without stopwords."""
    stop = F.array(*map(F.lit, D.STOPWORDS))
    return F.filter(raw_tokens(text), lambda t: ~F.array_contains(stop, t))


def exploded_words(df: DataFrame, text: Column, *columns: Column) -> DataFrame:
    """The columns and w: a row for each of `words`, filtered in generated code after the split."""
    rows = df.select(*columns, F.explode(F.split(cleaned(text), r"\s+")).alias("w"))
    return rows.where((F.length("w") >= 2) & ~F.col("w").isin(*D.STOPWORDS))


def analyse(text: Column, expand: bool = True) -> Column:
    """Index terms of a text in order: stopwords go, acronyms become their (unstemmed) words, others are stemmed and followed by those stemmed synonyms that the list does not hold yet."""
    if not expand:
        return F.transform(words(text), stem)
    acronyms = F.create_map(*[x for a, v in D.ACRONYMS.items() for x in (F.lit(a), F.array(*[F.lit(w) for w in v.split() if len(w) >= 2 and w not in D.STOPWORDS]))])
    stemmed = {k: [_stem(w) for w in v] for k, v in D.SYNONYMS.items()}
    synonyms = F.create_map(*[x for k, v in stemmed.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    none = F.array().cast("array<string>")

    def add(acc: Column, t: Column) -> Column:
        s = stem(t)
        with_stem = F.concat(acc, F.array(s))
        more = F.coalesce(F.element_at(synonyms, s), none)
        with_all = F.aggregate(more, with_stem, lambda a, m: F.when(F.array_contains(a, m), a).otherwise(F.concat(a, F.array(m))))
        return F.when(F.array_contains(F.map_keys(acronyms), t), F.concat(acc, F.coalesce(F.element_at(acronyms, t), none))).otherwise(with_all)

    return F.aggregate(words(text), none, add)


def _stem(w: str) -> str:
    """stem for one driver-side word."""
    return next((w[: -len(s)] + r for s, r in D.SUFFIXES if w.endswith(s) and len(w) > len(s) + 2), w)


def stems(words: pa.Array) -> pa.Array:
    """stem for an Arrow array of words."""
    length, rule = pc.utf8_length(words).to_numpy(), np.full(len(words), len(D.SUFFIXES))
    for n, (s, _) in reversed(list(enumerate(D.SUFFIXES))):
        rule[pc.ends_with(words, s).to_numpy(zero_copy_only=False) & (length > len(s) + 2)] = n
    order = np.argsort(rule, kind="stable")
    parts, ends = [], np.searchsorted(rule[order], np.arange(len(D.SUFFIXES) + 2))
    for n, (s, r) in enumerate(D.SUFFIXES):
        own = words.take(pa.array(order[ends[n] : ends[n + 1]]))
        parts.append(pc.binary_join_element_wise(pc.utf8_slice_codeunits(own, 0, -len(s)), r, ""))
    parts.append(words.take(pa.array(order[ends[-2] :])))
    return pa.concat_arrays(parts).take(pa.array(np.argsort(order)))


def short_id(*parts: Column, n: int = 16) -> Column:
    """The first n hex digits of the SHA-256 of the parts joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, n)


def highlights(text: Column, query: Column, around: int = 50, most: int = 3, low: Column | None = None) -> Column:
    """For each query word of two letters or more its first place in the text with some context; the first three.

    low: the text in lower case, where a column has it already; else it is made for each word.
    """
    low = F.lower(text) if low is None else low
    terms = F.filter(F.split(F.lower(query), r"\s+"), lambda t: F.length(t) >= 2)

    def snippet(t: Column) -> Column:
        at = F.instr(low, t) - 1
        start = F.greatest(F.lit(0), at - around)
        end = F.least(F.length(text), at + F.length(t) + around)
        cut = F.substring(text, start + 1, end - start)
        return F.when(at >= 0, F.concat(F.when(start > 0, "...").otherwise(""), cut, F.when(end < F.length(text), "...").otherwise("")))

    return F.slice(F.filter(F.transform(terms, snippet), lambda s: s.isNotNull()), 1, most)


def any_of(text: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.instr(text, n) > 0 for n in needles])


def doc_type(query: Column) -> Column:
    """The first document type, in order, one of whose keywords the query holds; else null."""
    return F.coalesce(*[F.when(any_of(query, ks), F.lit(t)) for t, ks in D.DOC_TYPES.items()])


def categories(query: Column) -> Column:
    """The categories one of whose keywords the query holds, in order."""
    return F.array_compact(F.array(*[F.when(any_of(query, ks), F.lit(c)) for c, ks in D.CATEGORIES.items()]))


def needs_synthesis(query: Column) -> Column:
    return any_of(query, D.SYNTHESIS) | query.endswith("?") | (F.size(F.split(F.trim(query), r"\s+")) > 10)


def query_type(query: Column) -> Column:
    return F.coalesce(*[F.when(any_of(query, ks), F.lit(t)) for t, ks in D.QUERY_TYPES], F.lit("factual"))


def adaptive_alpha(query: Column, low: float = 0.3, high: float = 0.6) -> Column:
    """The weight of a hypothetical answer by the length of the query."""
    n = F.size(F.split(F.trim(query), r"\s+"))
    mid = (low + high) / 2
    return F.when(n <= 3, low).when(F.trim(query).endswith("?") & (n <= 8), mid).when(n <= 10, F.lit(0.48)).otherwise(high)


def preview(text: Column, n: int = 200) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def context_prefix(file_name: Column, kind: Column, heading: Column, entities: Column, before: Column, after: Column, role: Column) -> Column:
    """The lines in front of a chunk: document, type, section, up to five entities, neighbours' summaries, role; absent or empty ones are left out."""
    line = lambda label, c: F.when(F.length(c) > 0, F.concat(F.lit(label + ": "), c))
    info = F.array_join(F.transform(F.slice(F.map_entries(entities), 1, 5), lambda e: F.concat_ws("=", e["key"], e["value"])), ", ")
    return F.concat_ws("\n", F.concat(F.lit("Document: "), file_name), F.concat(F.lit("Type: "), kind), line("Section", heading), line("Key info", info), line("Previous context", before), line("Following context", after), line("Context", role))


def chosen_markdown(reviewed: Column, extracted: Column) -> Column:
    """The reviewed text if there is any, else the extracted one."""
    return F.coalesce(F.nullif(reviewed, F.lit("")), extracted)
