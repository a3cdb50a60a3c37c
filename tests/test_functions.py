"""Exact values of text functions and folds."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as t
from quarry.operators import calls, chunk, fusion, ground, parse, rerank
from quarry.sources import documents
from quarry.streaming import ingest


def one(spark, s, f, kind="string"):
    return spark.createDataFrame([(s,)], f"s {kind}").select(f(F.col("s")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("s", "want"),
    [("One thing. Two things! Three things?", 3), ("Dr. Chen signed it. Then he left.", 2), ("", 0), ("J. R. Smith came. He saw.", 2), ("A first.\n\nA second", 2)],
)
def test_sentences(spark, s, want):
    assert len(one(spark, s, t.sentences)) == want


@pytest.mark.parametrize(("s", "want"), [("The Quick Brown Fox", ["quick", "brown", "fox"]), ("Contract NW-4417 renews soon", ["contract", "nw-4417", "renews", "soon"]), ("filed in 2024", ["filed", "2024"]), ("", [])])
def test_tokens(spark, s, want):
    assert one(spark, s, t.tokens) == want


def test_clean(spark):
    assert one(spark, "a\x07b hyphen-\nation\n\n\n\nx  y  ", t.clean) == "ab hyphenation\n\nx y"
    assert one(spark, "café-\nété", t.clean) == "caféété"


def test_lexical_support_weighs_numbers(spark):
    row = spark.createDataFrame([("Revenue was 48.2 million", "revenue was 48.2 million"), ("Revenue was 91.7 million", "revenue was 48.2 million")], "c string, e string")
    good, bad = [r[0] for r in row.select(t.lexical_support(F.col("c"), F.col("e"))).collect()]
    assert good == 1.0 and bad == pytest.approx(4 / 7)  # a name and a word of a name, a number and a word


def test_rrf_and_floor(spark):
    hits = spark.createDataFrame([(1, "dense", 1, 10, 0.9), (1, "dense", 2, 11, 0.8), (1, "sparse", 1, 11, 1.0), (1, "sparse", 2, 12, 0.5)], "query_id long, arm string, rank int, chunk_id long, score double")
    got = {r["chunk_id"]: r["rrf"] for r in fusion.rrf(hits).collect()}
    assert got[11] == pytest.approx(1 / 61 + 1 / 62) and got[10] == pytest.approx(1 / 61)
    assert [r["chunk_id"] for r in fusion.fuse(hits).orderBy("rank").collect()][0] == 11


@pytest.mark.parametrize(("weight", "want"), [(0.3, [1, 3]), (1.0, [1, 2])])
def test_mmr(spark, weight, want):
    rows = [(1, 1, 1, [1.0, 0.0], [1.0, 0.0]), (1, 2, 2, [1.0, 0.0], [0.99, 0.01]), (1, 3, 3, [1.0, 0.0], [0.0, 1.0])]
    df = spark.createDataFrame(rows, "query_id long, chunk_id long, rank int, query_embedding array<double>, embedding array<double>")
    assert [r["chunk_id"] for r in fusion.mmr(df, 2, weight).orderBy("pick").collect()] == want


@pytest.mark.parametrize(("blank", "want"), [(0.0, [1, 3, 2]), (float("nan"), [2, 1, 3])])
def test_mmr_vector_without_length(spark, blank, want):
    rows = [(1, 1, 1, [1.0, 0.0], [1.0, 0.0]), (1, 2, 3, [1.0, 0.0], [0.0, 0.0]), (1, 3, 2, [1.0, 0.0], [0.9, 0.1])]
    df = spark.createDataFrame(rows, "query_id long, chunk_id long, rank int, query_embedding array<double>, embedding array<double>")
    assert [r["chunk_id"] for r in fusion.mmr(df, 3, blank=blank).orderBy("pick").collect()] == want


def test_mmr_tail_has_no_vector(spark):
    rows = [(1, 1, 1, [1.0], None), (1, 2, 2, [1.0], [1.0])]
    df = spark.createDataFrame(rows, "query_id long, chunk_id long, rank int, query_embedding array<double>, embedding array<double>")
    assert [r["chunk_id"] for r in fusion.mmr(df, 2).orderBy("pick").collect()] == [2, 1]


def test_rerank(spark):
    rows = [(1, "gross margin", 1, "the cafeteria menu", 0.9, 1), (1, "gross margin", 2, "gross margin rose", 0.5, 2)]
    df = spark.createDataFrame(rows, "query_id long, question string, chunk_id long, text string, score double, rank int")
    assert rerank.rerank(df, 1).first()["chunk_id"] == 2
    assert rerank.rerank(df, 1, mode="off").first()["chunk_id"] == 1


def test_verification(spark):
    passages = ["Q3 revenue was $48.2 million, up 14.6 percent.", "Gross margin was 74.9% in the quarter."]
    rows = [(1, "Q3 revenue was $48.2 million [S1].", passages), (2, "The CEO resigned in March after a scandal.", passages), (3, "I could not find that in the context.", passages), (4, "Margin was 74.9% [S2].", [])]
    got = {r["answer_id"]: r for r in ground.ground(spark.createDataFrame(rows, "answer_id long, answer string, passages array<string>")).collect()}
    assert got[1]["verified"] and got[1]["confidence"] > 0.4
    assert got[2]["confidence"] < got[1]["confidence"] and not got[2]["verified"]
    assert got[3]["method"] == "refusal" and not got[3]["abstained"]
    assert got[4]["confidence"] == 0.0


def test_second_opinion_only_raises(spark):
    checked = spark.createDataFrame([(1, 0, 0.45, "partial"), (1, 1, 0.9, "supported")], "answer_id long, claim_idx int, support double, verdict string")
    v = spark.createDataFrame([(1, 0, "unsupported"), (1, 1, "unsupported")], "answer_id long, claim_idx int, verdict string")
    got = ground.second_opinion(checked, v).orderBy("claim_idx").collect()
    assert [(r["support"], r["verdict"]) for r in got] == [(0.45, "unsupported"), (0.9, "supported")]


def unit(s, section="", kind="text", hard=False):
    return {"text": s, "page": 1, "section": section, "kind": kind, "hard_break": hard}


def test_chunks():
    assert chunk.chunks_of([], 64, 8, 0) == []
    many = [unit("word " * 10) for _ in range(40)]
    got = chunk.chunks_of(many, 64, 8, 0)
    assert [c["chunk_index"] for c in got] == list(range(len(got))) and all(c["tokens"] <= 88 for c in got)
    two = chunk.chunks_of([unit("Alpha body.", "Alpha"), unit("Beta body.", "Beta", hard=True)], 64, 8, 48)
    assert [c["section"] for c in two] == ["Alpha", "Beta"]
    tail = chunk.chunks_of([unit("a b c d e f g h i j"), unit("k l"), unit("m n o p q r s t u v")], 16, 4, 0)
    assert tail[1]["text"].startswith("k l") and tail[1]["overlap_sentences"] == 1
    assert chunk.chunks_of([unit("x"), unit("y", hard=True)], 64, 0, 0, shifts=[False, True])[0]["sentences"] == 2


def test_chunk_size_over_overlap(spark):
    with pytest.raises(ValueError):
        chunk.chunk(spark.range(1), limit=50, overlap=50)


def test_embed_halves_a_failing_batch(spark):
    def encode(texts, role):
        if "poison" in texts:
            raise RuntimeError
        return [[float(len(s)), 0.0] for s in texts]

    assert calls.encode_all(encode, ["a", "poison", "ccc"], "query", 2) == [[1.0, 0.0], [0.0, 0.0], [3.0, 0.0]]
    rows = spark.createDataFrame([("a",), ("a",), (None,)], "text string")
    assert [r["embedding"] for r in calls.embed(rows, encode=encode, size=2).orderBy("text").collect()] == [None, [1.0, 0.0], [1.0, 0.0]]


def docx(path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda s, style="": f'<w:p>{f"""<w:pPr><w:pStyle w:val="{style}"/></w:pPr>""" if style else ""}<w:r><w:t>{s}</w:t></w:r></w:p>'
    cell = lambda s: f"<w:tc>{p(s)}</w:tc>"
    table = f"<w:tbl><w:tr>{cell('H1')}{cell('H2')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl>"
    with io.BytesIO() as b:
        with zipfile.ZipFile(b, "w") as z:
            z.writestr("word/document.xml", f"<w:document {w}><w:body>{p('Report', 'Heading1')}{p('Body text here.')}{table}</w:body></w:document>")
        path.write_bytes(b.getvalue())


def test_files_and_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "quarterly_notes.txt").write_text("Hello world\nLine two")
    (src / "latin.txt").write_bytes("Ça va bien aujourd'hui".encode("latin-1"))
    (src / "a.md").write_text("# Annual Report\n\n## Revenue\n\nRevenue rose sharply this year.")
    (src / "x.xlsx").write_text("data")
    (src / "none.md").write_text("   ")
    docx(src / "r.docx")
    got = {r["name"]: r for r in documents.documents(documents.files(spark, str(src))).collect()}
    assert got["quarterly_notes.txt"]["title"] == "quarterly notes" and got["a.md"]["title"] == "Annual Report"
    assert got["latin.txt"]["blocks"][0]["text"].startswith("Ça va")
    assert got["x.xlsx"]["error"] == "unsupported" and got["none.md"]["error"] == "empty"
    assert [b["kind"] for b in got["r.docx"]["blocks"]] == ["heading", "text", "table"]
    for _ in range(2):  # nothing is taken twice
        q = ingest.ingest(spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp"))
        assert q.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == len({r["id"] for r in rows}) >= 4
    assert any(r["section"] == "Annual Report > Revenue" and r["embed_text"].startswith("[Document: Annual Report") for r in rows)


def test_running_lines_go(spark):
    lines = spark.createDataFrame([("d", p, s) for p in range(5) for s in (f"Page {p}", f"Text {'x' * p}")], "doc string, page int, line string")
    rep = parse.repeated_lines(lines, "doc", "page")
    assert [r["line"] for r in rep.collect()] == ["Page #"]
    assert parse.without_repeated(lines, rep, "doc").count() == 5


def test_replies(spark):
    df = spark.createDataFrame([('x {"scores": [{"id": 1, "score": 7}, {"id": "2", "score": 20}, {"id": 9, "score": 1}, 3]}', '{"verdicts": [{"id": 1, "verdict": " Partial "}, {"id": 2, "verdict": "maybe"}]}', '{"intent": "banana", "search_queries": ["a", " ", 5, "c", "d"]}', "none")], "a string, b string, c string, d string")
    r = df.select(calls.listwise_scores(F.col("a"), F.lit(3)).alias("s"), calls.claim_verdicts(F.col("b")).alias("v"), calls.planned(F.lit("q"), F.col("c")).alias("p"), calls.planned(F.lit("q"), F.col("d")).alias("f")).first()
    assert r["s"] == {1: 0.7, 2: 1.0} and [tuple(x) for x in r["v"]] == [(1, "partial")]
    assert r["p"]["intent"] == "document_qa" and r["p"]["queries"] == ["a", "5", "c"] and r["p"]["needs_retrieval"] and r["p"]["standalone"] == "q"
    assert r["f"]["planner"] == "fallback" and r["f"]["queries"] == ["q"]
