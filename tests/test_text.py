"""Splitters, tokens and adapters against small models of their rules."""

import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import chunking as C
from inkwell.plans import adapters
from inkwell.sources import files, tabular


@pytest.mark.parametrize(("word", "stem"), [("workers", "worker"), ("compensation", "compensat"), ("business", "busi"), ("insurance", "insurance"), ("insured", "insur"), ("carrier", "carri"), ("carriers", "carrier"), ("exclusions", "exclusion"), ("deductible", "deduct")])
def test_stems(spark, word, stem):
    df = spark.createDataFrame([(word,)], "w string")
    assert df.select(T.stem(F.col("w"))).first()[0] == T._stem(word) == df.selectExpr(T.stem_sql("w")).first()[0] == stem


def test_expanded_tokens(spark):
    df = spark.createDataFrame([("WC claim, the carriers' COI!",), ("do d&o",), ("",)], "t string")
    got = [r[0] for r in df.select(T.analyse(F.col("t"))).collect()]
    assert got[0][:3] == ["workers", "compensation", "claim"]
    assert got[0][3:6] == ["los", "incident", "occurrence"]
    assert got[0][-2:] == ["certificate", "insurance"] and "carrier" in got[0]
    assert got[1] == [] and got[2] == []


@pytest.mark.parametrize(("q", "alpha"), [("claim", 0.3), ("what is the claim process?", 0.45), ("how do claims work here", 0.48), ("one two three four five six seven eight nine ten eleven", 0.6)])
def test_alpha(spark, q, alpha):
    assert spark.createDataFrame([(q,)], "q string").select(T.adaptive_alpha(F.col("q"))).first()[0] == pytest.approx(alpha)


@pytest.mark.parametrize(("q", "kind"), [("compare a vs b", "comparative"), ("how many claims", "aggregation"), ("summary of x", "aggregation"), ("why x", "exploratory"), ("policy 12", "factual")])
def test_query_types(spark, q, kind):
    assert spark.createDataFrame([(q,)], "q string").select(T.query_type(F.col("q"))).first()[0] == kind


def test_chunk_id(spark):
    assert spark.range(1).select(T.short_id(F.lit("a"), F.lit(0))).first()[0] == "0ed32d3352f0cddd"


def test_split_text():
    assert C.split_text("a\n\nb\n\n" + "c" * 30, 20) == ["a\n\nb", "c" * 30]
    assert C.split_text("One. Two? Three! a|b", 8) == ["One.", "Two?", "Three! a", "b"]
    assert C.split_text(" \n\n ", 10) == []


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab .?!\n", max_size=300), st.integers(5, 60))
def test_packing_respects_size_and_keeps_letters(text, size):
    out = C.split_text(text, size)
    assert "".join(out).translate(str.maketrans("", "", " \n")) == text.translate(str.maketrans("", "", " \n"))
    for p in out:
        assert len(p) <= size + 2 or not any(x in p.strip() for x in (". ", "? ", "! ", "\n\n"))


def test_markdown():
    md = "# A\nintro\n\n## B\n| x | y |\n\n| 1 | 2 |\nafter\n- one\n- two\n# C\n```\n# not a heading\n```\n## Empty"
    got = C.markdown_chunks(md)
    assert [(t, k, p) for t, k, _, p, _ in got] == [
        ("A", "title", "A"), ("intro", "paragraph", "A"), ("B", "section_header", "A > B"), ("| x | y |\n\n| 1 | 2 |", "table", "A > B"),
        ("after", "paragraph", "A > B"), ("- one\n- two", "paragraph", "A > B"), ("C", "title", "C"), ("```\n# not a heading\n```", "paragraph", "C"),
    ]
    assert [c[4] for c in got] == [-1, 0, 0, 2, 2, 2, -1, 6]
    assert C.markdown_chunks("- a\n- b")[0][1] == "list" and C.markdown_chunks("![x](y)")[0][1] == "figure" and C.markdown_chunks("") == []


def test_long_content():
    text = "\n\n".join(["word " * 30] * 3).strip()
    parts = C.split_content(text, 200)
    assert all(len(p) <= 200 for p in parts) and "".join(parts).split() == text.split()
    assert C.split_content("One two. " * 50, 100)[0].endswith("two.")


def test_sentences():
    text = "First sentence here. Second one follows! short. Third sentence\nis here."
    assert [s for s, *_ in C.sentences(text)][0] == "First sentence here."
    assert all(text[a:z].strip() == s for s, a, z in C.sentences(text))
    assert C.split_at("a" * 60 + "b" * 60, [60]) == ["a" * 60, "b" * 60] and C.split_at("short", [2]) == ["short"]


def test_row_batches(spark):
    df = spark.createDataFrame([(i, None if i == 3 else f"v{i}") for i in range(120)], "a int, b string")
    got = sorted(map(tuple, C.row_batches(df, ["a", "b"], ["a"]).collect()))
    assert [g[0] for g in got] == [0, 1, 2] and got[0][2].split("\n")[:2] == ["Columns: a, b", "Row 1: a=0, b=v0"]
    assert "Row 4: a=3\n" in got[0][2] and got[1][2].split("\n")[1] == "Row 51: a=50, b=v50"
    cut = C.row_batches(df, ["a", "b"], ["a"], size=200).collect()
    assert all(len(r["text"]) <= 400 and r["text"].startswith("Columns: a, b\nRow") for r in cut)
    assert sum(r["text"].count("Row ") for r in cut) == 120


def test_adapters(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, ""), (3, None)], "id int, t string")
    v = {r["id"]: r["vector"] for r in adapters.embedded(df, "t", adapters.HashingEmbedder).collect()}
    assert sum(x * x for x in v[1]) == pytest.approx(1, abs=1e-5) and not any(v[2]) and not any(v[3])
    reply = adapters.completed(df, F.col("t"), adapters.ExtractiveModel).withColumn("r", adapters.parse_json(F.col("reply"), "title string, keywords array<string>"))
    assert {r["id"]: r["r"]["title"] for r in reply.collect()}[1] == "alpha beta"
    pairs = spark.createDataFrame([("alpha x", "has alpha")], "q string, t string")
    assert adapters.pair_scored(pairs, "q", "t", adapters.OverlapScorer).first()["pair_score"] == 0.5


def office(parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, x in parts.items():
            z.writestr(n, x)
    return b.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
PA = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
DOCX = f"<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val='Heading2'/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
PPTX = f"<p:sld {PA}><p:sp><p:nvSpPr><p:nvPr><p:ph type='title'/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>Title</a:t></a:r></a:p></p:txBody></p:sp><p:sp><p:txBody><a:p><a:r><a:t>Point</a:t></a:r></a:p></p:txBody></p:sp></p:sld>"


def test_office_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.docx").write_bytes(office({"word/document.xml": DOCX}))
    (tmp_path / "b.pptx").write_bytes(office({"ppt/slides/slide1.xml": PPTX}))
    (tmp_path / "c.txt").write_text("plain")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    found = files.discover(spark, str(tmp_path), content=True)
    got = {r["file_name"]: r for r in found.join(files.default_registry().parse(found), "id").collect()}
    assert got["a.docx"]["markdown"] == "## Top\n\nBody\n\n| a\\|b | c |\n| --- | --- |"
    assert got["b.pptx"]["markdown"] == "## Slide 1: Title\n\n- Point" and got["c.txt"]["markdown"] == "plain"
    assert "no reader" in got["d.pdf"]["error"] and got["bad.docx"]["error"].startswith("BadZipFile")
    known = found.select("id", F.lit("indexed").alias("processing_status"))
    top = files.listing(found, known, f"file:{tmp_path}").collect()
    assert [(r["name"], r["is_dir"]) for r in top] == [("sub", True), ("b.pptx", False), ("bad.docx", False), ("c.txt", False), ("d.pdf", False)]


def test_discover_large_files(spark, tmp_path, monkeypatch):
    (tmp_path / "small.csv").write_text("a\n1\n")
    with open(tmp_path / "large.csv", "wb") as f:
        f.truncate(files.MAX_BYTES + 1)
    found = files.discover(spark, str(tmp_path)).withColumn("e", files.upload_error(F.col("file_name"), F.col("length")))
    assert {r["file_name"]: r["e"] for r in found.collect()} == {"small.csv": None, "large.csv": "File too large (max 100MB)"}
    monkeypatch.setattr(files, "ROW_BYTES", 100)
    held = files.discover(spark, str(tmp_path), content=True)
    assert {r["file_name"]: r["file_hash"] is None for r in held.collect()} == {"small.csv": False, "large.csv": True}
    assert {r["error"] for r in files.default_registry().parse(held.where("file_name = 'large.csv'")).collect()} == {"no content"}


def test_csv(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_bytes("name,n\nJosé,1\n".encode("iso-8859-1"))
    assert files.read_csv(spark, str(p)).collect()[0]["name"] == "José"


def test_csv_reader_and_pieces():
    rows = "name,n\n" + "".join(f"José {i},{i if i % 2 else ''}\n" for i in range(120))
    for encoding in ("utf-8", "utf-8-sig", "iso-8859-1", "utf-16"):
        data = rows.encode(encoding)
        assert files.csv_markdown(data).count("\n") == 121 and "| José 119 | 119 |" in files.csv_markdown(data)
        got = tabular.pieces("csv", data, "x.csv", None)
        assert [k for _, k, _ in got[:3]] == ["summary", "schema", "paragraph"] and got[1][0] == "Columns in x.csv:\n  - name: text\n  - n: integer"
        lines = [x for t, k, _ in got if k == "row_batch" for x in t.split("\n")[1:]]
        assert lines == [f"Row {i + 1}: name=José {i}" + (f", n={i}" if i % 2 else "") for i in range(120)]
    assert files.csv_markdown(b"a\n" + b"x" * 200_000).count("x") == 200_000
    assert "parsing failed" in tabular.pieces("csv", b"", "x.csv", "s")[1][0]
