"""Files as documents: plain text, markdown and DOCX with what Python has; PDF through a library if there is one."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import SETTINGS
from quarry.operators import admin, calls, chunk, parse

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, length, content, file_type, reason): all files below a path; reason says why one can't be taken. Spark's reader passes over files of no bytes."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = raw.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "length", "content")
    return admin.verdicts(named).withColumn("file_type", F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1)))


def docx_blocks(content: bytes) -> list[dict]:
    """Blocks of a DOCX file: headings by style, then the tables as markdown, on pages of equal length."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    body, out, chars, page = root.find(f"{W}body"), [], 0, 1

    def put(text: str, kind: str, level: int = 0) -> None:
        out.append({"block_idx": len(out), "text": text, "page": page, "kind": kind, "level": level})

    said = lambda node: "".join(t.text or "" for t in node.iter(f"{W}t")).strip()
    for p in body.findall(f"{W}p"):
        text = said(p)
        style = p.find(f"{W}pPr/{W}pStyle")
        name = (style.get(f"{W}val") or "").lower() if style is not None else ""
        if not text:
            continue
        if name.startswith("heading") or name == "title":
            digits = "".join(c for c in name if c.isdigit())
            put(text, "heading", min(4, int(digits)) if digits else 1)
        else:
            put(text, "text")
        chars += len(text)
        if chars > SETTINGS.docx_page_chars:
            page, chars = page + 1, 0
    for table in body.findall(f"{W}tbl"):
        rows = [[said(c) for c in r.findall(f"{W}tc")] for r in table.findall(f"{W}tr")]
        rows = [r for r in rows if any(r)]
        if len(rows) > 1:
            put(_table(rows), "table")
    return out


def pdf_pages(content: bytes) -> list[dict]:
    """Laid-out lines and tables of a PDF file, as parse.layout_blocks() takes them; needs a PDF library on the executors."""
    import pymupdf  # optional

    out = []
    with pymupdf.open(stream=content, filetype="pdf") as pdf:
        for number, page in enumerate(pdf, start=1):
            lines = [line for area in page.get_text("dict").get("blocks", []) if area.get("type") == 0 for line in area.get("lines", [])]
            texts = [("".join(s.get("text", "") for s in line.get("spans", [])).strip(), line["spans"][0].get("size") if line.get("spans") else None) for line in lines]
            out += [{"page": number, "place": i, "line": text, "size": size, "markdown": None} for i, (text, size) in enumerate(texts)]
            for i, found in enumerate(page.find_tables()):
                out.append({"page": number, "place": i, "line": None, "size": None, "markdown": _table(found.extract())})
    if not any(x["line"] for x in out):
        raise ValueError("no text: the pages may be images")
    return out


def _table(rows: list[list]) -> str:
    """A table as markdown, as parse.table_markdown() writes it."""
    kept = [r for r in ([" ".join((c or "").split("\n")).strip() for c in row] for row in rows) if any(r)]
    if len(kept) < 2:
        return ""
    line = lambda r: "| " + " | ".join(r + [""] * (len(kept[0]) - len(r))) + " |"
    return "\n".join([line(kept[0]), "|" + "|".join(["---"] * len(kept[0])) + "|", *map(line, kept[1:61])])


PAGES = "array<struct<page:int,place:int,line:string,size:double,markdown:string>>"


def pdf_documents(found: DataFrame, read=pdf_pages) -> DataFrame:
    """(path, name, file_type, blocks, error) of PDF files: read(content) gives a file's laid-out lines; a bad file is a row with an error."""

    def laid_out(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            pages, errors = [], []
            for content in f["content"]:
                try:
                    pages.append(read(content))
                    errors.append(None)
                except Exception as e:  # the file's fault or a missing library: reported in the row
                    pages.append([])
                    errors.append(f"{type(e).__name__}: {e}"[:1000])
            yield pd.DataFrame({"path": f["path"], "name": f["name"], "file_type": f["file_type"], "pages": pages, "error": errors})

    rows = found.select("path", "name", "file_type", "content").mapInPandas(laid_out, f"path string, name string, file_type string, pages {PAGES}, error string")
    flat = rows.select(F.col("path").alias("document_id"), F.inline("pages"))
    lines, tables = flat.where("line is not null").drop("markdown"), flat.where("markdown is not null").select("document_id", "page", "place", "markdown")
    made = parse.layout_blocks(lines, tables).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("block_idx", "text", "page", "kind", "level"))).cast(f"array<{parse.BLOCK}>").alias("blocks"))
    joined = rows.drop("pages").join(made.withColumnRenamed("document_id", "path"), "path", "left")
    return joined.select("path", "name", "file_type", F.coalesce("blocks", F.array().cast(f"array<{parse.BLOCK}>")).alias("blocks"), F.coalesce("error", F.when(F.col("blocks").isNull(), "empty")).alias("error"))


def documents(found: DataFrame) -> DataFrame:
    """(path, name, title, file_type, blocks, error) from files(): a bad file is a row with an error, not a failed job."""
    text = parse.parse(found.withColumn("text", parse.decoded(F.col("content"))).where("reason is null and file_type in ('txt', 'md', 'markdown')"))
    text = text.select("path", "name", "file_type", "blocks", F.when(F.size("blocks") == 0, "empty").alias("error"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            blocks, errors = [], []
            for content in f["content"]:
                try:
                    made = docx_blocks(content)
                    blocks.append(made)
                    errors.append(None if made else "empty")
                except Exception as e:  # the file's fault or a missing library: reported in the row
                    blocks.append([])
                    errors.append(f"{type(e).__name__}: {e}"[:1000])
            yield pd.DataFrame({"path": f["path"], "name": f["name"], "file_type": f["file_type"], "blocks": blocks, "error": errors})

    binary = found.where("reason is null and file_type = 'docx'").select("path", "name", "file_type", "content")
    binary = binary.mapInPandas(read, f"path string, name string, file_type string, blocks array<{parse.BLOCK}>, error string")
    bad = found.where("reason is not null").select("path", "name", "file_type", F.array().cast(f"array<{parse.BLOCK}>").alias("blocks"), F.col("reason").alias("error"))
    every = text.unionByName(binary).unionByName(pdf_documents(found.where("reason is null and file_type = 'pdf'"))).unionByName(bad)
    heading = F.try_element_at(F.filter("blocks", lambda b: b["kind"] == "heading"), F.lit(1))["text"]
    first = F.try_element_at("blocks", F.lit(1))["text"]
    return every.withColumn("title", parse.title_of(heading, F.col("name"), first))


def write_chunks(chunks: DataFrame, path: str, version: int, by: str = "document_id", buckets: int = 64) -> None:
    """Stores the chunks of whole documents as a version (a number greater than those before), in place of what is stored of these
    documents; other documents stay. Versions are appended, so a job that is lost half-way leaves what was there."""
    rows = chunks.withColumn("version", F.lit(version).cast("long")).withColumn("bucket", F.pmod(F.xxhash64(by), F.lit(buckets)))
    rows.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)


def read_chunks(spark: SparkSession, path: str, by: str = "document_id") -> DataFrame:
    """Every stored document's chunks of its last version."""
    rows = spark.read.parquet(path)
    last = rows.groupBy("bucket", by).agg(F.max("version").alias("version"))
    return rows.join(last, ["bucket", by, "version"], "left_semi").drop("bucket", "version")


def land(found: DataFrame, folder: str, documents_path: str, request: str | None = None) -> DataFrame:
    """The upload: accepted files' bytes are appended to a landing table, their rows to the documents as pending; gives back found with reasons.

    found: path, name, length, content. The landing table is Parquet by id, so it can be in any store that Spark writes to.
    """
    judged = admin.verdicts(found, request)
    good = judged.where("reason is null")
    good.select(F.md5("path").alias("id"), F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1)).alias("file_type"), "content").write.mode("append").parquet(folder)
    admin.pending(good).write.mode("append").parquet(documents_path)
    return judged


def fingerprint(provider: str, model: str, size: int) -> str:
    """What an index was embedded with; stored beside it and compared before a search."""
    return f"{provider}:{model}:{size}"


def check_fingerprint(spark: SparkSession, folder: str, wanted: str) -> str:
    """new (it is written), same or changed (the stored one stays: embed anew with reindex())."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
        spark.createDataFrame([(wanted,)], "value string").coalesce(1).write.text(folder)
        return "new"
    stored = spark.read.text(folder).first()["value"].strip()
    return "same" if stored in ("", wanted) else "changed"


def embedded_with(vectors: DataFrame, wanted: str, model: str = "model", embedding: str = "embedding") -> DataFrame:
    """(fingerprint, vectors, fits): how many vectors were made with what, and whether that is what is wanted."""
    made = F.concat_ws(":", F.col(model), F.size(embedding).cast("string"))
    return vectors.groupBy(made.alias("fingerprint")).agg(F.count("*").alias("vectors")).withColumn("fits", F.col("fingerprint") == wanted)


def reindex(chunks: DataFrame, document: str | None = None, encode=None, headers: bool = True) -> DataFrame:
    """(chunk_id, document_id, embed_text, embedding): every stored chunk, or those of one document, embedded anew under a header
    of the present settings.

    chunks: chunk_id, document_id, text and, which may be null, title, section and page.
    """
    rows = chunks if document is None else chunks.where(F.col("document_id").cast("string") == document)
    rows = rows.withColumns({"title": F.coalesce("title", F.lit("")), "section": F.coalesce("section", F.lit("")), "page": F.coalesce("page", F.lit(0))})
    rows = chunk.with_headers(rows) if headers else rows.withColumn("embed_text", F.col("text"))
    return calls.embed(rows.select("chunk_id", "document_id", "embed_text"), "embed_text", "passage", encode)


# --- evaluation sets --------------------------------------------------------------------------------------------------

QUESTION = "struct<question:string,expects:array<string>,relevant:array<string>,answerable:boolean>"


def evaluation_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """documents (filename, text) and questions (query_id, question, expects, relevant, answerable) of a JSON file {"documents": [...], "questions": [...]}."""
    whole = spark.read.schema(f"documents array<struct<filename:string,text:string>>, questions array<{QUESTION}>").json(path, multiLine=True)
    asked = whole.select(F.posexplode("questions").alias("query_id", "q")).select(F.col("query_id").cast("long").alias("query_id"), "q.question", *[F.coalesce(f"q.{n}", F.array().cast("array<string>")).alias(n) for n in ("expects", "relevant")], F.coalesce("q.answerable", F.lit(True)).alias("answerable"))
    return whole.select(F.inline("documents")), asked


def write_results(results: DataFrame, path: str) -> None:
    """Results as JSON lines."""
    results.write.mode("overwrite").json(path)
