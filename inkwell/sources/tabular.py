"""CSV and spreadsheet files as pieces of text: summary, schema, sheets, description, and every row in batches."""

from __future__ import annotations

import io

import pandas as pd

from inkwell.operators.chunking import CHUNK_SIZE, ROWS_PER_CHUNK, pack, split_text
from inkwell.sources.files import decoded

Piece = tuple[str, str, str]  # text, content type, heading


def read(kind: str, data: bytes) -> list[tuple[str | None, pd.DataFrame]]:
    """(sheet, table) of a file; a CSV is one table without a sheet. Whole numbers stay whole beside empty cells."""
    if kind == "csv":
        return [(None, pd.read_csv(io.StringIO(decoded(data)), dtype_backend="numpy_nullable"))]
    return list(pd.read_excel(io.BytesIO(data), sheet_name=None, dtype_backend="numpy_nullable").items())


def column_type(s: pd.Series) -> str:
    """integer, decimal, boolean, datetime, date_string, currency or text; the strings by their first ten values."""
    if pd.api.types.is_bool_dtype(s.dtype):
        return "boolean"
    if pd.api.types.is_datetime64_any_dtype(s.dtype):
        return "datetime"
    if pd.api.types.is_numeric_dtype(s.dtype):
        return "integer" if pd.api.types.is_integer_dtype(s.dtype) else "decimal"
    some = s.dropna().head(10).astype(str)
    try:
        if len(some) and pd.to_datetime(some).notna().all():
            return "date_string"
    except (ValueError, OverflowError):
        pass
    return "currency" if some.str.contains("[$€£¥₹]").any() else "text"


def row_lines(df: pd.DataFrame) -> list[str]:
    """`Row n: a=1, b=2` of each row, empty cells left out."""
    names = list(map(str, df.columns))
    return [f"Row {n}: " + ", ".join(f"{c}={v}" for c, v in zip(names, row, strict=True) if pd.notna(v)) for n, row in enumerate(df.itertuples(index=False, name=None), 1)]


def description(df: pd.DataFrame, title: str) -> str:
    """Rows, columns with their kinds, totals of numbers and the first five rows in words."""
    lines = [title, f"Total rows: {len(df)}", "Columns: " + ", ".join(map(str, df.columns)), "", "Column Details:"]
    for c, s in df.items():
        distinct, kind = s.nunique(), column_type(s)
        lines.append(f"  - {c}: {kind} ({distinct} unique values)")
        if distinct <= 10 and kind in ("text", "currency", "date_string"):
            lines.append("    Sample values: " + ", ".join(map(str, s.dropna().unique()[:5])))
    numbers = [c for c, s in df.items() if column_type(s) in ("integer", "decimal") and s.notna().any()]
    if numbers:
        lines += ["", "Numeric Summaries:", *(f"  - {c}: Total={df[c].sum():,.2f}, Average={df[c].mean():,.2f}" for c in numbers)]
    return "\n".join([*lines, "", "Sample Data:", *(f"  {x}" for x in row_lines(df.head(5)))])


def pieces(kind: str, data: bytes | None, name: str, summary: str | None, size: int = CHUNK_SIZE, per_chunk: int = ROWS_PER_CHUNK) -> list[Piece]:
    """The pieces of a file in order. The schema names the first 30 columns, as the one copied; the rows are all there, with every column.

    A file that can't be read has its summary and a piece that says why.
    """
    out: list[Piece] = [(summary or f"Tabular file: {name}", "summary", "File Summary")]
    try:
        if data is None:
            raise ValueError("no content")
        tables = read(kind, data)
    except Exception as e:
        return [*out, (f"[{kind.upper()} parsing failed: {e}]", "paragraph", "Data Content")]
    typed = [(f"{sheet}.{c}" if sheet else str(c), column_type(s)) for sheet, df in tables for c, s in df.items()]
    if typed:
        out.append(("\n".join([f"Columns in {name}:", *(f"  - {c}: {t}" for c, t in typed[:30])]), "schema", "Data Schema"))
    out += [(f"Sheet: {sheet}\nColumns: {', '.join(map(str, df.columns))}\n{len(df)} rows", "table", f"Sheet: {sheet}") for sheet, df in tables if sheet]
    text = "\n\n".join(description(df, f"--- Sheet: {sheet} ---" if sheet else f"CSV File: {name}") for sheet, df in tables)
    out += [(t, "paragraph", "Data Content") for t in split_text(text, size) if t.strip()]
    for _, df in tables:
        header, lines = "Columns: " + ", ".join(map(str, df.columns)), row_lines(df)
        for at in range(0, len(lines), per_chunk):
            some = lines[at : at + per_chunk]
            whole = "\n".join([header, *some])
            texts = [whole] if len(whole) <= 2 * size else [f"{header}\n{x}" for x in pack(some, 2 * size - len(header), "\n", 1)]
            out += [(t, "row_batch", "Row Data") for t in texts]
    return out
