"""Documents of several formats as rows, and tolerant JSON. A file that cannot be read gives an error, never a failed job."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The order of formats in an index, by suffix.
FORMATS = ("pdf", "ocr", "docx", "pptx", "xlsx", "txt")
# Words in the head of a column and the role they give it, in the order they are tried.
ROLES = (("title", ("title", "题名", "标题", "篇名")), ("author", ("author", "作者")), ("method", ("method", "方法")), ("keywords", ("keyword", "关键词")), ("abstract", ("abstract", "摘要")), ("journal", ("journal", "期刊", "来源")), ("year", ("year", "年")))


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, filename, format, content, position) of all files below a folder, in the order of formats and names."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.when(name.rlike(r"(?i)_ocr\.txt$"), "ocr").otherwise(suffix)
    rank = F.array_position(F.array(*map(F.lit, FORMATS)), kind)
    return f.select("path", name.alias("filename"), kind.alias("format"), "content", rank.alias("rank")).where("rank > 0")


def _local(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _paragraphs(root: ElementTree.Element) -> list[str]:
    """Texts of the paragraphs below an element that are not blank."""
    found = ("".join(x.text or "" for x in p.iter() if _local(x) == "t") for p in root.iter() if _local(p) == "p")
    return [t for t in found if t.strip()]


def docx(raw: bytes) -> str:
    """Paragraphs outside of tables, then the cells of all tables, row by row; blank ones are left out."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    body = next((e for e in root if _local(e) == "body"), root)
    out = [t for e in body if _local(e) == "p" for t in _paragraphs(e)]
    for table in (e for e in body if _local(e) == "tbl"):
        cells = ("\n".join(_paragraphs(c)).strip() for row in table if _local(row) == "tr" for c in row if _local(c) == "tc")
        out += [t for t in cells if t]
    return "\n".join(out)


def _notes(z: zipfile.ZipFile, slide: str) -> str:
    """The notes that belong to a slide, '' for none."""
    links = slide.replace("slides/", "slides/_rels/") + ".rels"
    if links not in z.namelist():
        return ""
    target = next((r.get("Target", "") for r in ElementTree.fromstring(z.read(links)) if r.get("Type", "").endswith("/notesSlide")), "")
    name = "ppt/" + target.removeprefix("../").removeprefix("/ppt/")
    if name not in z.namelist():
        return ""
    shapes = (e for e in ElementTree.fromstring(z.read(name)).iter() if _local(e) == "sp")
    # The number of the slide stands in a shape of its own kind.
    spoken = (t for e in shapes if not any(_local(x) == "ph" and x.get("type") in ("sldNum", "sldImg", "hdr", "ftr", "dt") for x in e.iter()) for t in _paragraphs(e))
    return "\n".join(t.strip() for t in spoken)


def pptx(raw: bytes) -> str:
    """Slides with a number line each, their texts and table cells, then their notes; a slide that has none of these is left out."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        out = []
        for k, n in enumerate(names, 1):
            lines = [t.strip() for t in _paragraphs(ElementTree.fromstring(z.read(n)))]
            if notes := _notes(z, n):
                lines.append(f"[notes] {notes}")
            if lines:
                out.append("\n".join([f"[slide {k}]", *lines]))
    return "\n\n".join(out)


_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_LITERAL = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}


def _string(raw: bytes) -> str:
    """A string of a PDF: UTF-16 with a mark, else Latin."""
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        got = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        got = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], b"" if m[1].strip() == b"" else m[1]), raw[1:-1], flags=re.S)
    return got.decode("utf-16", "replace") if got[:2] in (b"\xfe\xff", b"\xff\xfe") else got.decode("latin-1")


def pdf_metadata(raw: bytes) -> dict[str, str]:
    """title and author of a PDF whose information is not packed, '' where there is none."""
    objects = dict(_OBJECT.findall(raw))
    info = re.search(rb"/Info\s+(\d+)\s+\d+\s+R", raw)
    body = objects.get(info[1], b"") if info else b""
    field = lambda name: (m := re.search(rb"/" + name + rb"\s*(" + _LITERAL.pattern + rb")", body, re.S)) and _string(m[1]).strip() or ""
    return {"title": field(b"Title"), "author": field(b"Author")}


def pdf_pages(raw: bytes) -> list[str]:
    """The text of each page of a plain PDF: no packed objects, no encryption, fonts with a Latin encoding. Others need a reader of their own."""
    if not raw.startswith(b"%PDF") or b"/Encrypt" in raw:
        raise ValueError("not a plain PDF")
    objects = dict(_OBJECT.findall(raw))
    out = []
    for body in (o for _, o in _OBJECT.findall(raw) if re.search(rb"/Type\s*/Page\b", o)):
        found = re.search(rb"/Contents\s*(?:\[(.*?)\]|(\d+\s+\d+\s+R))", body, re.S)
        lines: list[str] = []
        for ref in re.findall(rb"(\d+)\s+\d+\s+R", (found[1] or found[2]) if found else b""):
            part = re.search(rb"(.*?)stream\r?\n(.*)endstream", objects.get(ref, b""), re.S)
            if not part:
                continue
            code = zlib.decompressobj().decompress(part[2]) if b"FlateDecode" in part[1] else part[2]
            for block in re.findall(rb"\bBT\b(.*?)\bET\b", code, re.S):
                text = ""
                for m in re.finditer(_LITERAL.pattern + rb"|\b(?:Td|TD|Tm)\b|T\*|'", block, re.S):
                    text += _string(m[0]) if m[0][:1] in b"(<" else "\n"
                lines += [t for t in text.split("\n") if t.strip()]
        out.append("\n".join(lines))
    if not out:
        raise ValueError("no pages")
    return out


def pdf(raw: bytes) -> str:
    """The pages of a PDF that have text, one below the other."""
    return "\n".join(t for t in pdf_pages(raw) if t.strip())


def document_title(title: Column, filename: Column) -> Column:
    """The title that a document gives itself, else its file's name without the extension."""
    return F.coalesce(F.nullif(F.trim(title), F.lit("")), F.regexp_replace(filename, r"\.[^.]*$", ""))


def xlsx(raw: bytes) -> list[list[list[str]]]:
    """Sheets as rows of texts."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter() if t.tag.endswith("}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if si.tag.endswith("}si")]
        sheets = []
        for n in sorted(x for x in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", x)):
            rows = []
            for row in (r for r in ElementTree.fromstring(z.read(n)).iter() if r.tag.endswith("}row")):
                cells: list[str] = []
                for c in (c for c in row if c.tag.endswith("}c")):
                    letters = re.match(r"[A-Z]+", c.get("r", "")) or [""]
                    at = 0
                    for ch in letters[0]:
                        at = at * 26 + ord(ch) - 64
                    v = next((x.text or "" for x in c.iter() if x.tag.endswith("}v") or x.tag.endswith("}t")), "")
                    cells += [""] * (max(at, len(cells) + 1) - len(cells))
                    cells[-1] = shared[int(v)] if c.get("t") == "s" and v else v
                rows.append(cells)
            sheets.append(rows)
    return sheets


def role(header: str) -> str | None:
    low = header.lower()
    return next((r for r, words in ROLES if any(w in low for w in words)), None)


def header_role(c: Column) -> Column:
    """The role of a column by its head, as a column expression."""
    out = None
    for r, words in ROLES:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.lower(c), F.lit(w))
        out = F.when(hit, r) if out is None else out.when(hit, r)
    return out


def papers_of_sheets(sheets: list[list[list[str]]]) -> list[dict[str, str]]:
    """Rows with a title; sheets of less than two rows or without a title column are left out; a later column of a role replaces an earlier one."""
    out = []
    for rows in sheets:
        if len(rows) < 2:
            continue
        place = {r: i for i, h in enumerate(rows[0]) if (r := role(h))}
        if "title" not in place:
            continue
        for row in rows[1:]:
            rec = {r: row[i].strip() if i < len(row) else "" for r, i in place.items()}
            if rec["title"]:
                out.append(rec)
    return out


def paper_text(rec: dict[str, str]) -> str:
    """A row as labelled lines; empty fields are left out."""
    journal = rec.get("journal", "") + (f" ({rec['year']})" if rec.get("journal") and rec.get("year") else "")
    fields = [("title", rec.get("title")), ("author", rec.get("author")), ("method", rec.get("method")), ("keywords", rec.get("keywords")), ("abstract", rec.get("abstract")), ("journal", journal)]
    return "\n".join(f"{k}: {v}" for k, v in fields if v)


def extracted(listing: DataFrame, pdf_reader: Callable[[bytes], str] = pdf) -> DataFrame:
    """(filename, format, rank, title, text, error) of listed files; pdf_reader is any callable bytes -> text.

    title is that of a PDF's own information, else null. A file that cannot be
    read has an error and no text.
    """

    def one(kind: str, raw: bytes) -> tuple[str | None, str]:
        if kind == "docx":
            return None, docx(raw)
        if kind == "pptx":
            return None, pptx(raw)
        if kind == "xlsx":
            return None, "\n\n".join(map(paper_text, papers_of_sheets(xlsx(raw))))
        if kind == "pdf":
            return pdf_metadata(raw)["title"] or None, pdf_reader(raw)
        return None, raw.decode("utf-8", "replace")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, kind, rank, raw in zip(b["filename"], b["format"], b["rank"], b["content"]):
                try:
                    out.append((name, kind, rank, *one(kind, bytes(raw)), None))
                except Exception as e:  # noqa: BLE001  a bad file must not end the job
                    out.append((name, kind, rank, None, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(out, columns=["filename", "format", "rank", "title", "text", "error"])

    return listing.select("filename", "format", "rank", "content").mapInPandas(run, "filename string, format string, rank long, title string, text string, error string")


def outcomes(texts: DataFrame, pieces: DataFrame, known: DataFrame) -> DataFrame:
    """(filename, blocks, state) of each file read: -1 and failed, 0 and blank, or the number of its pieces and new, or skipped if it was known before.

    texts has filename, text and error; pieces and known have filename.
    """
    made = pieces.groupBy("filename").agg(F.count("*").alias("_n"))
    j = texts.select("filename", "error").join(made, "filename", "left").join(known.select("filename", F.lit(True).alias("_known")).distinct(), "filename", "left")
    blocks = F.when(F.col("error").isNotNull(), -1).otherwise(F.coalesce("_n", F.lit(0)))
    state = F.when(F.coalesce("_known", F.lit(False)), "skipped").when(blocks < 0, "failed").when(blocks == 0, "blank").otherwise("new")
    return j.select("filename", blocks.cast("bigint").alias("blocks"), state.alias("state"))


def build_report(found: DataFrame) -> DataFrame:
    """One row: how many files are new, failed, blank and skipped, and how many pieces the new ones have."""
    return found.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("new", "failed", "blank", "skipped")], F.coalesce(F.sum(F.when(F.col("state") == "new", F.col("blocks"))), F.lit(0)).alias("pieces"))


def companions(texts: DataFrame) -> DataFrame:
    """Scanned texts named after the PDF they belong to, where there is one."""
    pdfs = texts.where("format = 'pdf'").select(F.col("filename").alias("pdf")).distinct()
    named = texts.withColumn("_pdf", F.when(F.col("format") == "ocr", F.regexp_replace("filename", r"(?i)_ocr\.txt$", ".pdf")))
    return named.join(pdfs, named["_pdf"] == pdfs["pdf"], "left").withColumn("filename", F.coalesce("pdf", "filename")).drop("_pdf", "pdf")


def tolerant_json(c: Column, schema: str) -> Column:
    """The object from the first { to the last } of a reply; if it cannot be read, without trailing commas; else null."""
    raw = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    fixed = F.regexp_replace(raw, r",(\s*[}\]])", "$1")
    return F.coalesce(F.from_json(F.when(raw == fixed, raw), schema), F.from_json(fixed, schema))


def appended(rows: DataFrame, path: str) -> None:
    """An append-only JSON lines sink."""
    rows.write.mode("append").json(path)


def _present(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def credibility_scores(spark: SparkSession, path: str) -> DataFrame:
    """(filename, credibility, doc_kind) of a JSON object filename -> record; records without a score are left out, a missing or unreadable file gives none."""
    schema = "filename string, credibility double, doc_kind string"
    if not _present(spark, path):
        return spark.createDataFrame([], schema)
    pairs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, variant>")).alias("filename", "v"))
    record = F.from_json(F.when(F.schema_of_variant("v").startswith("OBJECT"), F.to_json("v")), "credibility double, doc_kind string")
    return pairs.select("filename", record.alias("r")).where("r.credibility is not null").select("filename", "r.credibility", "r.doc_kind")


def extract_cache(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """(path, record) of the JSON files of a folder in the order of their names; those that cannot be read as an object are passed over."""
    if not _present(spark, f"{folder}/*.json"):
        return spark.createDataFrame([], f"path string, record struct<{schema}>")
    raw = spark.read.text(f"{folder}/*.json", wholetext=True).select(F.col("_metadata.file_name").alias("path"), "value")
    whole = F.try_parse_json("value")
    return raw.where(whole.isNotNull()).where(F.schema_of_variant(whole).startswith("OBJECT")).select("path", F.from_json("value", schema).alias("record")).orderBy("path")


def account_records(raw: DataFrame) -> DataFrame:
    """(account, password) of JSON texts: an object account -> password, in which names that begin with _ are notes, or a list of objects with account and password.

    raw has value. Accounts are stripped; other texts give none.
    """
    v = F.try_parse_json("value")
    named = raw.where(v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT")).select(F.explode(F.from_json("value", "map<string, string>")).alias("account", "password")).where(~F.startswith("account", F.lit("_")))
    listed = raw.where(v.isNotNull() & F.schema_of_variant(v).startswith("ARRAY")).select(F.explode(F.from_json("value", "array<struct<account: string, password: string>>")).alias("r")).select("r.account", "r.password").where("account is not null")
    return named.unionByName(listed).select(F.trim("account").alias("account"), "password")


def rule_file(path: str, fallback: dict[str, list[dict]]) -> dict[str, list[dict]]:
    """Sections of rules of a YAML file; the built-in ones where it is missing, cannot be read or has no sections."""
    try:
        import yaml

        with open(path, encoding="utf-8") as f:
            got = yaml.safe_load(f)
    except Exception:  # noqa: BLE001  a bad configuration must not end the job
        return fallback
    sections = {str(k): [r for r in v if isinstance(r, dict)] for k, v in got.items() if isinstance(v, list)} if isinstance(got, dict) else {}
    return sections or fallback
