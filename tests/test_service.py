"""Model clients and providers, routes of answers, uploads, layout, evaluation sets, reindexing."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as t
from quarry.functions.vectors import hashed
from quarry.operators import admin, bm25, calls, dense, evaluate, models, parse, respond, retrieve
from quarry.sources import documents


# --- providers ------------------------------------------------------------------------------------------------------


def service(replies, **kw):
    waits, asked = [], []

    def post(payload):
        asked.append(payload)
        return replies[min(len(asked), len(replies)) - 1]

    return models.TypedService(post, "model-v4", sleep=waits.append, **kw), asked, waits


@pytest.mark.parametrize(("role", "task"), [("query", "retrieval.query"), ("passage", "retrieval.passage"), ("similarity", "text-matching"), ("bogus", "retrieval.passage")])
def test_payload(role, task):
    made = service([], size=1024)[0].payload(["one", "two"], role)
    assert made == {"model": "model-v4", "task": task, "input": [{"text": "one"}, {"text": "two"}], "truncate": True, "dimensions": 1024}
    assert "dimensions" not in service([])[0].payload(["x"], role)


def test_service_orders_and_tries_again():
    good = (200, {"data": [{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}]})
    one, asked, waits = service([(429, {}), (503, {}), (200, {"data": []}), good])
    assert one.encode(["a", "b"], "query") == [[1.0], [2.0]] and len(asked) == 4
    assert [1 <= waits[0] <= 1.25, 2 <= waits[1] <= 2.5, 4 <= waits[2] <= 5] == [True] * 3
    with pytest.raises(RuntimeError, match="401"):
        service([(401, {})])[0].encode(["a"])
    with pytest.raises(RuntimeError, match="after 2 tries"):
        service([(500, {})], tries=2)[0].encode(["a"])


def test_local_model_prefixes_queries_only():
    local = models.LocalModel(lambda texts: [[len(t), 0] for t in texts], "small", query_prefix="ask: ")
    assert local.size == 2 and local.encode(["ab"], "query") == [[7.0, 0.0]] and local.encode(["ab"], "passage") == [[2.0, 0.0]]


def test_first_that_loads():
    def broken():
        raise ImportError("no such library")

    assert models.first_that_loads("Hosted", {"hosted": broken, "stub": lambda: "stub"}) == "stub"
    assert models.first_that_loads("b", {"a": lambda: "a", "b": lambda: "b"}) == "b"
    with pytest.raises(RuntimeError, match="hosted: no such library"):
        models.first_that_loads("unheard-of", {"hosted": broken})


# --- completions ----------------------------------------------------------------------------------------------------


def client(script, names=("a", "b"), **kw):
    told, waits = [], []

    def call(model, prompt):
        told.append(model)
        step = script[min(len(told), len(script)) - 1]
        if isinstance(step, Exception):
            raise step
        return step

    return models.Client(call, names, sleep=waits.append, **kw), told, waits


def test_breaker():
    now = [0.0]
    b = models.Breaker(3, 10, lambda: now[0])
    for _ in range(2):
        b.told(False)
    assert b.state == "closed"
    b.told(False)
    assert b.state == "open"
    now[0] = 10.0
    assert b.state == "half_open"
    b.told(False)
    assert b.state == "open"
    b.told(True)
    assert b.state == "closed" and b.failures == 0


def test_complete_retries_and_fails_over():
    e = models.CallError
    one, told, waits = client([e("rate limit", 429), "fine"])
    assert one.complete("x") == {"text": "fine", "model": "a", "attempts": 2, "degraded": False} and 0.8 <= waits[0] <= 1.05
    one, told, waits = client([e("model decommissioned"), " ok "])
    assert one.complete("x") == {"text": "ok", "model": "b", "attempts": 2, "degraded": True} and not waits
    one, told, waits = client([e("boom"), e("try again in 3s", 429), e("x", headers={"retry-after": "999"}, status=503), "late"])
    assert one.complete("x")["attempts"] == 4 and waits == [pytest.approx(3.25), models.SETTINGS.call_timeout / 2]
    one, told, waits = client([""], names=("a",))
    with pytest.raises(models.Unavailable, match="empty"):
        one.complete("x")
    assert told == ["a"] and one.breaker.failures == 1
    one, told, waits = client([e("timeout")], breaker=models.Breaker(2))
    for _ in range(2):
        with pytest.raises(models.Unavailable, match="after 6 attempts"):
            one.complete("x")
    with pytest.raises(models.Unavailable, match="breaker"):
        one.complete("x")
    assert len(told) == 12


@pytest.mark.parametrize(("message", "headers", "want"), [("try again in 3.66s", {}, 3.66), ("Try again in 450ms", {}, 0.45), ("try again in 9s", {"retry-after": "2"}, 2), ("x", {"retry-after-ms": "1500"}, 1.5), ("x", {"retry-after": "soon"}, None), ("boom", {}, None)])
def test_wait_asked(spark, message, headers, want):
    assert models.wait_asked(models.CallError(message, headers=headers)) == want
    got = spark.createDataFrame([(message, headers)], "m string, h map<string,string>").select(calls.retry_after(F.col("m"), F.col("h"))).first()[0]
    assert got == (pytest.approx(want) if want is not None else None)


def test_completions_are_rows(spark):
    def make():
        return models.Client(lambda model, prompt: prompt.upper() if prompt != "bad" else (_ for _ in ()).throw(models.CallError("boom")), ("m",))

    got = {r["id"]: r for r in models.completions(spark.createDataFrame([(1, "good"), (2, "bad")], "id long, p string"), "id", "p", make).collect()}
    assert got[1]["text"] == "GOOD" and got[1]["error"] is None and got[2]["text"] is None and "boom" in got[2]["error"]


# --- plans and answers ----------------------------------------------------------------------------------------------


def test_plans(spark):
    reply = lambda **kw: json.dumps({"intent": "summarize", "standalone_question": "", "search_queries": []} | kw)
    rows = [("hey there!", None), ("Sum it up", reply()), ("Compare", reply(intent="compare", hypothetical_answer="h" * 900)), ("Hm?", reply(intent="meta", hypothetical_answer="x", needs_retrieval=True)), ("Odd", reply(needs_retrieval="no")), ("Not", reply(needs_retrieval=False)), ("None", None), ("Empty", "{}"), (" q ", reply(intent="banana", search_queries=["a", 5, "", "c", "d"]))]
    got = [r["p"] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, q string, r string").select("i", calls.plan_query(F.col("q"), F.col("r")).alias("p")).orderBy("i").collect()]
    assert [p["intent"] for p in got] == ["chitchat", "summarize", "compare", "meta", "summarize", "summarize", "document_qa", "document_qa", "document_qa"]
    assert [p["needs_retrieval"] for p in got] == [False, True, True, False, True, False, True, True, True]
    assert [p["planner"] for p in got] == ["heuristic", *["llm"] * 5, "fallback", "fallback", "llm"]
    assert len(got[2]["hyde"]) == 600 and got[3]["hyde"] == "" and got[8]["queries"] == ["a", "5", "c"] and got[8]["standalone"] == "q"
    alone = spark.createDataFrame([("What now?",)], "q string").select(calls.plan_query(F.col("q")).alias("p")).first()["p"]
    assert alone["planner"] == "heuristic" and alone["queries"] == ["What now?"]


def test_routes(spark):
    asked = spark.createDataFrame([(1, "chitchat", None, ""), (2, "meta", None, "You have 2 files."), (3, "document_qa", None, ""), (4, "document_qa", None, ""), (5, "document_qa", "Q3 revenue was $48.2 million [S1].", ""), (6, "document_qa", "The moon is made of green cheese, they say [S2].", "")], "query_id long, intent string, reply string, hint string")
    hits = spark.createDataFrame([(q, 1, 10, "Report > p.1", "Q3 revenue was $48.2 million, up 14.6 percent.", 0.9) for q in (1, 4, 5, 6)] + [(5, 2, 11, "Menu", "The cafeteria serves soup.", 0.4)], "query_id long, rank int, chunk_id long, label string, text string, score double")
    got = {r["query_id"]: r for r in respond.respond(asked, hits).collect()}
    assert [got[i]["mode"] for i in range(1, 7)] == ["chitchat", "chitchat", "no_context", "extractive", "grounded", "grounded"]
    assert got[1]["answer"] == respond.GREETING and "2 files" in got[2]["answer"] and got[1]["confidence"] == 1.0 and got[1]["sources"] == []
    assert got[3]["answer"] == respond.NOT_FOUND and got[3]["confidence"] == 0.0 and got[3]["warnings"] == [respond.CANNED]
    assert got[4]["confidence"] == 0.35 and "**[S1] Report > p.1** (match 90%)" in got[4]["answer"] and got[4]["degraded"] and got[4]["warnings"] == [respond.VERBATIM]
    assert got[5]["grounded"] and [s["cited"] for s in got[5]["sources"]] == [True, False] and not got[5]["degraded"]
    assert "removed 1 invented citation(s)" in got[6]["warnings"] and not got[6]["grounded"]


def test_retrieval_modes_and_rounds(spark, monkeypatch):
    texts = ["alpha beta gamma", "alpha beta", "delta epsilon", "zeta eta theta", "alpha delta zeta"] + [f"filler{i} words{i}" for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    index = bm25.build(docs, "chunk_id", F.col("text"))
    vectors = docs.select("chunk_id", hashed(F.col("text")).alias("embedding"))
    asked = spark.createDataFrame([(1, "alpha beta", ["alpha beta ", None, "theta"]), (2, "nothing known here", [])], "query_id long, question string, extras array<string>")
    assert sorted((r["query_id"], r["i"], r["text"]) for r in retrieve.fan_out(asked).collect()) == [(1, 0, "alpha beta"), (1, 1, "theta"), (2, 0, "nothing known here")]
    sparse = retrieve.retrieve(asked, index, vectors, mode="sparse").collect()
    assert {r["chunk_id"] for r in sparse} == {0, 1, 3, 4} and {r["query_id"] for r in sparse} == {1} and all(r["sources"] == ["sparse"] for r in sparse)
    both = retrieve.retrieve(asked, index, vectors, top_k=2).where("query_id = 1").orderBy("rank").collect()
    assert both[0]["chunk_id"] in (0, 1) and len(both) <= 20 and [r["rank"] for r in both] == list(range(1, len(both) + 1))
    assert retrieve.retrieve(asked, index, vectors, mode="unheard-of").collect() == []
    few = retrieve.retrieve(asked, index, vectors, allowed=spark.createDataFrame([(4,)], "chunk_id long"), mode="hybrid").where("query_id = 1").collect()
    assert {r["chunk_id"] for r in few} == {4}
    want = sorted(map(tuple, sparse))
    monkeypatch.setattr(bm25, "ROUND", 1)
    monkeypatch.setattr(bm25, "CELLS", 1)
    assert sorted(map(tuple, retrieve.retrieve(asked, index, vectors, mode="sparse").collect())) == want


def test_dense_rounds_halves_up(spark):
    """Cosines of 1/32 and 45/128: halves at four digits, and at the six by which hits are ranked."""
    rank = lambda q, *v: [tuple(r) for r in dense.search(spark.createDataFrame([(0, [float(x) for x in q])], "query_id long, embedding array<double>"), spark.createDataFrame([(i, [float(x) for x in own]) for i, own in enumerate(v, 1)], "chunk_id long, embedding array<double>").coalesce(1), 1).collect()]
    assert rank([3, 3, 3, -6, 4, 2, 6, -3], [-9, -2, -4, -5, 5, -6, 3, 2]) == [(0, 1, 1, 0.0313)]
    near = [-5, 2, 1, 1, -4, 7, -4, 4]
    assert rank([-6, 5, 6, 1, -1, 2, 5, 0], near, [-5 - 1e-6] + near[1:]) == [(0, 1, 1, 0.3516)]


def test_dense_in_rounds(spark, monkeypatch):
    v = spark.range(200).select(F.col("id").alias("chunk_id"), F.array(*[F.rand(i) - 0.5 for i in range(8)]).alias("embedding")).persist()
    asked = v.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    once = sorted(map(tuple, dense.search(asked, v, 7).collect()))
    monkeypatch.setattr(dense, "ROUND_BYTES", 200)
    monkeypatch.setattr(dense, "CELLS", 64)
    assert sorted(map(tuple, dense.search(asked, v, 7).collect())) == once and len(once) == 70
    assert dense.search(asked.where("false"), v, 7).collect() == []
    assert dense.search(asked, v.where("false"), 7).collect() == []


# --- files ----------------------------------------------------------------------------------------------------------


def test_uploads_land(spark, tmp_path):
    rows = [("r1", f"/in/{i}.md", f"{i}.md", 3, b"abc") for i in range(21)] + [("r2", "/in/a.PDF", "a.PDF", 2, b"xy"), ("r2", "/in/b.exe", "b.exe", 1, b"z"), ("r2", "/in/c.txt", "c.txt", 0, b"")]
    found = spark.createDataFrame(rows, "request string, path string, name string, length long, content binary")
    judged = {r["path"]: r["reason"] for r in documents.land(found, str(tmp_path / "landing"), str(tmp_path / "documents"), "request").collect()}
    assert judged["/in/0.md"] == "too many files" and judged["/in/a.PDF"] is None and judged["/in/b.exe"] == "unsupported" and judged["/in/c.txt"] == "empty"
    doc, file = spark.read.parquet(str(tmp_path / "documents")).collect(), spark.read.parquet(str(tmp_path / "landing")).collect()
    assert [(r["filename"], r["file_type"], r["file_size"], r["status"]) for r in doc] == [("a.PDF", "pdf", 2, "pending")] and [(r["id"], bytes(r["content"])) for r in file] == [(doc[0]["id"], b"xy")]


def test_get_and_purge(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    assert admin.get(docs, "id", 2).first()["name"] == "b"
    with pytest.raises(KeyError):
        admin.get(docs, "id", 3)
    kept = admin.purge({"documents": (docs, "id"), "chunks": (spark.createDataFrame([(1,), (1,), (2,)], "document_id long"), "document_id")}, docs.where("id = 1"), "id")
    assert kept["documents"].count() == 1 and kept["chunks"].count() == 1


def test_laid_out_pages(spark):
    def pages(content):
        if content == b"broken":
            raise ValueError("not a PDF")
        out, names = [], ["", "first", "second", "third", "fourth", "fifth"]
        for page in range(1, 6):
            lines = [(f"Confidential {page}", 8.0), ("1 Scope" if page == 1 else f"Part {page}", 16.0), (f"Body text of the {names[page]} page goes on,", 10.0), (f"and ends {names[page]}.", 10.0), ("INTERNAL", 10.0) if page == 2 else (f"Sized {names[page]}", 12.0), (f"- {page} -", 8.0)]
            out += [{"page": page, "place": i, "line": s, "size": z, "markdown": None} for i, (s, z) in enumerate(lines)]
        return [*out, {"page": 2, "place": 0, "line": None, "size": None, "markdown": "| a |\n|---|\n| 1 |"}]

    found = spark.createDataFrame([("p1", "r.pdf", "pdf", b"fine"), ("p2", "x.pdf", "pdf", b"broken")], "path string, name string, file_type string, content binary")
    got = {r["path"]: r for r in documents.pdf_documents(found, pages).collect()}
    assert got["p2"]["error"] == "ValueError: not a PDF" and got["p2"]["blocks"] == []
    told = [(b["page"], b["kind"], b["level"], b["text"]) for b in got["p1"]["blocks"]]
    assert told[:2] == [(1, "heading", 1, "1 Scope"), (1, "text", 0, "Body text of the first page goes on,\nand ends first.")] and told[2] == (1, "heading", 2, "Sized first")
    assert (2, "heading", 2, "INTERNAL") in told and [t for t in told if t[0] == 2][-1] == (2, "table", 0, "| a |\n|---|\n| 1 |")
    assert not any("Confidential" in t[3] or t[3].startswith("- ") for t in told) and got["p1"]["blocks"][0]["block_idx"] == 0


def test_running_lines(spark):
    texts = ["Top 1\n\nTop 2\nfirst\nFoot", "Top 3\nTop 9\nsecond\nFoot", "Top 5\nthird\nFoot", "Top 7\nfourth\nelse", "Foot"]
    rows = [("d", p, i, s) for p, text in enumerate(texts) for i, s in enumerate(text.split("\n"))]
    df = spark.createDataFrame(rows, "doc string, page int, place int, line string")
    kept = sorted((r["page"], r["place"], r["line"]) for r in parse.running_lines(df, "doc", "page", "place").collect())
    assert [s for p, _, s in kept if p == 0] == ["", "Top 2", "first"] and [s for p, _, s in kept if p == 1] == ["second"] and [s for p, _, s in kept if p == 3] == ["fourth", "else"] and not [1 for p, *_ in kept if p == 4]
    assert parse.running_lines(df.where("page < 3"), "doc", "page", "place").count() == df.where("page < 3").count()


def test_evaluation_set_and_report(spark, tmp_path):
    path = tmp_path / "set.json"
    path.write_text(json.dumps({"documents": [{"filename": "a.md", "text": "# A"}], "questions": [{"question": "q1", "expects": ["42"], "relevant": ["Alpha"]}, {"question": "q2", "expects": [], "relevant": ["beta"]}, {"question": "q3", "answerable": False}, {"question": "q4", "answerable": False}]}))
    docs, asked = documents.evaluation_set(spark, str(path))
    assert docs.first()["filename"] == "a.md" and [r["answerable"] for r in asked.orderBy("query_id").collect()] == [True, True, False, False]
    given = spark.createDataFrame([(0, "It is  42.", 0.9, True, False), (1, "It is 42.", 0.9, False, False), (2, "withheld", 0.1, False, False), (3, "It is 42.", 0.2, False, False)], "query_id long, answer string, confidence double, grounded boolean, abstained boolean")
    sources = spark.createDataFrame([(0, 1, "Other"), (0, 2, "The ALPHA part"), (1, 1, None)], "query_id long, rank int, section string")
    rows = evaluate.outcomes(asked, given, sources)
    assert [r["outcome"] for r in rows.orderBy("query_id").collect()] == ["ok", "MISS", "declined", "HALLUCINATED"]
    r = evaluate.summary(rows).first()
    assert (r["questions"], r["recall"], r["mrr"], r["precision"], r["answer_accuracy"], r["groundedness"], r["correct_abstention"]) == (4, 0.5, 0.25, 0.25, 0.5, 0.5, 0.5)
    documents.write_results(evaluate.summary(rows), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first()["questions"] == 4


def test_fingerprints_and_reindex(spark, tmp_path):
    folder = str(tmp_path / "fingerprint")
    mark = documents.fingerprint("hashed", "v1", 64)
    assert [documents.check_fingerprint(spark, folder, m) for m in (mark, mark, "hashed:v2:64", mark)] == ["new", "same", "changed", "same"]
    chunks = spark.createDataFrame([("a::0", "a", "Body.", "T", None, 2), ("b::0", "b", "Other.", None, "S", None)], "chunk_id string, document_id string, text string, title string, section string, page int")
    got = {r["chunk_id"]: r for r in documents.reindex(chunks, encode=lambda texts, role: [[float(len(t))] for t in texts]).collect()}
    assert got["a::0"]["embed_text"] == "[Document: T | Page: 2]\nBody." and got["b::0"]["embed_text"] == "[Section: S | Page: 0]\nOther." and got["b::0"]["embedding"] == [29.0]
    assert [r["embed_text"] for r in documents.reindex(chunks, document="b", headers=False).collect()] == ["Other."]


def test_chunks_are_stored_by_version(spark, tmp_path):
    path = str(tmp_path / "chunks")
    rows = lambda *r: spark.createDataFrame(r, "document_id string, chunk_index int, text string")
    documents.write_chunks(rows(("a", 0, "a0"), ("a", 1, "a1"), ("b", 0, "b0"), *[(f"d{i}", 0, "x") for i in range(20)]), path, 1, buckets=2)
    documents.write_chunks(rows(("a", 0, "new")), path, 2, buckets=2)
    got = documents.read_chunks(spark, path)
    assert got.columns == ["document_id", "chunk_index", "text"] and got.count() == 22
    assert [(r["document_id"], r["text"]) for r in got.where("document_id in ('a', 'b')").orderBy("document_id").collect()] == [("a", "new"), ("b", "b0")]


def test_vectors_are_stored(spark, tmp_path):
    def encode(texts, role):
        return [[float(len(t)), float(calls.ROLES.index(role))] for t in texts]

    def broken(texts, role):
        raise RuntimeError

    rows = spark.createDataFrame([("a",), ("bb",), ("a",), (None,)], "text string")
    ask = lambda rows, encode, role="passage": sorted((r["text"] or "", tuple(r["embedding"] or ())) for r in calls.embed_stored(rows, str(tmp_path / "v"), "stub:1", encode=encode, size=2, role=role).collect())
    first = ask(rows, encode)
    assert first == [("", ()), ("a", (1.0, 1.0)), ("a", (1.0, 1.0)), ("bb", (2.0, 1.0))]
    assert ask(rows, broken) == first and ask(rows.limit(1), broken, "query") == [("a", (0.0, 0.0))]
    assert spark.read.parquet(str(tmp_path / "v")).count() == 3


def test_tokens_by_a_vocabulary(spark):
    paths = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = paths.path("byte_bpe_50k.json")
    texts = ["Hello world, it's 2024.", "", None, "naïve café"]
    own = tokenizers.Tokenizer.from_file(path)
    got = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", t.token_count_by(F.col("s"), path).alias("n")).orderBy("i").collect()
    assert [r["n"] for r in got] == [len(own.encode(s or "", add_special_tokens=False).ids) for s in texts]
