"""Files as tables: type by header, text by format, and office packages read with the standard library."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from docloom.functions.text import clean_text, word_count
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OOXML = "application/vnd.openxmlformats-officedocument."
#: Types and extensions of office packages by the folder of their main part.
OFFICE = {
    "word/": (_OOXML + "wordprocessingml.document", ".docx"),
    "xl/": (_OOXML + "spreadsheetml.sheet", ".xlsx"),
    "ppt/": (_OOXML + "presentationml.presentation", ".pptx"),
}
#: Native words of a PDF from which no character recognition is needed.
NATIVE_WORDS = 30


def read_files(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """path, modificationTime, length and content of the files of a folder, at once or as they come."""
    if not stream:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(path)


def _package_kind(content: bytes) -> str | None:
    try:
        names = zipfile.ZipFile(io.BytesIO(content)).namelist()
    except zipfile.BadZipFile:
        return None
    return next((k for k in OFFICE if any(n.startswith(k) for n in names)), None)


def package_kind(content: Column) -> Column:
    """Folder of an office package's main part."""

    @F.pandas_udf("string")
    def kind(contents: pd.Series) -> pd.Series:
        return pd.Series([_package_kind(c) if c else None for c in contents], dtype=object)

    return kind(content)


def file_type(content: Column) -> Column:
    """struct(mime, extension) by the first bytes, null when they are of no known kind; only ZIPs are opened."""
    head = F.hex(F.substring(content, 1, 8))
    kind = package_kind(F.when(head.rlike("^504B(0304|0506|0708)"), content))
    pair = lambda mime, ext: F.struct(F.lit(mime).alias("mime"), F.lit(ext).alias("extension"))
    office = F.coalesce(*[F.when(kind == k, pair(*v)) for k, v in OFFICE.items()])
    return (
        F.when(F.startswith(head, F.lit("255044462D")), pair("application/pdf", ".pdf"))
        .when(F.startswith(head, F.lit("FFD8FF")), pair("image/jpeg", ".jpg"))
        .when(head == "89504E470D0A1A0A", pair("image/png", ".png"))
        .otherwise(office)
    )


def document_kind(mime: Column, name: Column) -> Column:
    """pdf, image, sheet, word or other, by type or, where that tells nothing, by extension."""
    mime, name = F.lower(F.coalesce(mime, F.lit(""))), F.lower(F.coalesce(name, F.lit("")))
    sheet = F.contains(mime, F.lit("spreadsheet")) | F.contains(mime, F.lit("excel")) | F.contains(mime, F.lit("csv")) | name.rlike(r"\.(xlsx|xls|csv)$")
    word = F.contains(mime, F.lit("wordprocessing")) | F.contains(mime, F.lit("msword")) | name.rlike(r"\.docx?$")
    return (
        F.when((mime == "application/pdf") | name.rlike(r"\.pdf$"), "pdf")
        .when(F.startswith(mime, F.lit("image/")) | name.rlike(r"\.(jpe?g|png|gif|webp|bmp)$"), "image")
        .when(sheet, "sheet").when(word, "word").otherwise("other")
    )


def with_type(files: DataFrame) -> DataFrame:
    """Files with their real type and the path that fits it; clash tells whether that path is taken by another file."""
    typed = files.withColumn("type", file_type(F.col("content")))
    fitted = F.coalesce(F.concat(F.regexp_replace("path", r"\.[^./]*$", ""), "type.extension"), F.col("path"))
    typed = typed.withColumn("fitted_path", fitted)
    taken = files.select(F.col("path").alias("fitted_path"), F.lit(True).alias("taken"))
    joined = typed.join(taken, "fitted_path", "left")
    return joined.withColumn("clash", F.coalesce("taken", F.lit(False)) & (F.col("fitted_path") != F.col("path"))).drop("taken")


def _numbered(names: list[str], pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in names if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def _texts(xml: bytes, tag: str) -> list[str]:
    return [e.text or "" for e in ElementTree.fromstring(xml).iter() if e.tag.rpartition("}")[2] == tag]


def docx_text(content: bytes) -> str:
    """Paragraphs of a document, one a line."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    paragraphs = [p for p in root.iter() if p.tag.rpartition("}")[2] == "p"]
    return "\n".join("".join(e.text or "" for e in p.iter() if e.tag.rpartition("}")[2] == "t") for p in paragraphs)


def pptx_text(content: bytes) -> str:
    """Slides in the order of their numbers, parted by blank lines."""
    z = zipfile.ZipFile(io.BytesIO(content))
    slides = [" ".join(t for t in _texts(z.read(n), "t") if t) for n in _numbered(z.namelist(), r"ppt/slides/slide(\d+)\.xml")]
    return "\n\n".join(s for s in slides if s)


def _column(ref: str) -> int:
    total = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        total = total * 26 + ord(c) - 64
    return total - 1


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _each(package: zipfile.ZipFile, name: str, tag: str) -> Iterator[ElementTree.Element]:
    """The elements of a tag in a part of a package, one at a time; what has been read is dropped."""
    with package.open(name) as part:
        above: list[ElementTree.Element] = []
        for event, e in ElementTree.iterparse(part, ("start", "end")):
            if event == "start":
                above.append(e)
                continue
            above.pop()
            if _local(e) == tag:
                yield e
                if above:
                    above[-1].remove(e)


def xlsx_rows(content: bytes) -> Iterator[tuple[int, str, int, list[str]]]:
    """(sheet number, sheet name, row number, cells) of a workbook, row by row; gaps are empty cells. Shared strings are held, sheets are not."""
    z = zipfile.ZipFile(io.BytesIO(content))
    names = z.namelist()
    shared, titles = [], []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in i.iter() if _local(t) == "t") for i in _each(z, "xl/sharedStrings.xml", "si")]
    if "xl/workbook.xml" in names:
        titles = [e.get("name") or "" for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(e) == "sheet"]
    for s, name in enumerate(_numbered(names, r"xl/worksheets/sheet(\d+)\.xml")):
        title = titles[s] if s < len(titles) else f"Sheet{s + 1}"
        for r, row in enumerate(_each(z, name, "row")):
            cells: list[str] = []
            for cell in (c for c in row if _local(c) == "c"):
                at = _column(cell.get("r") or "")
                at = len(cells) if at < 0 else at
                cells += [""] * (at + 1 - len(cells))
                value = next((v.text or "" for v in cell if _local(v) == "v"), "")
                if cell.get("t") == "s":
                    value = shared[int(value)] if value.isdigit() and int(value) < len(shared) else ""
                elif cell.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in cell.iter() if _local(t) == "t")
                cells[at] = value.replace("_x000D_", "").replace("\r", "").replace("\n", "\\n").strip()
            yield s, title, r, cells


def xlsx_text(content: bytes) -> str:
    """Sheets as a name and rows of joined cells, parted by blank lines."""
    sheets: dict[int, list[str]] = {}
    for s, title, _, cells in xlsx_rows(content):
        sheets.setdefault(s, [title]).append(" | ".join(cells))
    return "\n\n".join("\n".join(lines) for lines in sheets.values())


#: Rows of sheets that leave a task at once.
SHEET_ROWS = 2000
_SHEET = [("path", pa.string()), ("sheet_no", pa.int32()), ("sheet", pa.string()), ("row_no", pa.int32()), ("cells", pa.list_(pa.string()))]


def _rows_of(files: DataFrame, read: Callable[[bytes], Iterator[tuple[int, str, int, list[str]]]]) -> DataFrame:
    """(path, sheet_no, sheet, row_no, cells) of the files of a table: rows leave a task as they are read, a sheet of any length by SHEET_ROWS."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                rows = ((path.as_py(), *r) for r in read(content.as_py() or b""))
                while part := list(islice(rows, SHEET_ROWS)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*part), _SHEET)], schema=pa.schema(_SHEET))

    return files.select("path", "content").mapInArrow(run, "path string, sheet_no int, sheet string, row_no int, cells array<string>")


def workbook_rows(files: DataFrame) -> DataFrame:
    """(path, sheet_no, sheet, row_no, cells) of all workbooks of a file table, at once or as a stream; a file that is no package has no rows."""

    def read(content: bytes) -> Iterator[tuple[int, str, int, list[str]]]:
        return xlsx_rows(content) if zipfile.is_zipfile(io.BytesIO(content)) else iter(())

    return _rows_of(files, read)


def csv_rows(files: DataFrame, delimiter: str = ",") -> DataFrame:
    """(path, sheet_no, sheet, row_no, cells) of all CSV files of a file table, at once or as a stream, as sheets of one name."""

    def read(content: bytes) -> Iterator[tuple[int, str, int, list[str]]]:
        lines = csv.reader(io.TextIOWrapper(io.BytesIO(content), "utf-8-sig", "replace", newline=""), delimiter=delimiter)
        return ((0, "Sheet1", r, [c.strip() for c in cells]) for r, cells in enumerate(lines))

    return _rows_of(files, read)


def unlike_names(names: Column) -> Column:
    """The names with a repeated one numbered: A, A_1, A_2, and so on past names that are there already."""
    numbered = lambda taken, n: F.transform(
        F.sequence(F.lit(0), F.size(taken)), lambda i: F.when(i == 0, n).otherwise(F.concat(n, F.lit("_"), i.cast("string")))
    )
    free = lambda taken, n: F.get(F.filter(numbered(taken, n), lambda x: ~F.array_contains(taken, x)), F.lit(0))
    return F.aggregate(names, F.array().cast("array<string>"), lambda taken, n: F.concat(taken, F.array(free(taken, n))))


def records(rows: DataFrame) -> DataFrame:
    """(path, sheet_no, row_no, record): rows under their sheet's first row as a map by its cells, a nameless
    column named by its number, a repeated name numbered, blank rows left out."""
    header = rows.where("row_no = 0").select("path", "sheet_no", F.col("cells").alias("header"))
    filled = rows.where((F.col("row_no") > 0) & F.exists("cells", lambda c: F.trim(c) != ""))
    joined = filled.join(header, ["path", "sheet_no"])
    names = F.transform("header", lambda h, i: F.when(F.trim(h) == "", F.concat(F.lit("Col "), (i + 1).cast("string"))).otherwise(F.trim(h)))
    values = F.transform("header", lambda h, i: F.coalesce(F.get("cells", i), F.lit("")))
    return joined.select("path", "sheet_no", "row_no", F.map_from_arrays(unlike_names(names), values).alias("record"))


def _office_text(content: bytes, kind: str | None) -> str:
    readers: dict[str, Callable[[bytes], str]] = {"word/": docx_text, "xl/": xlsx_text, "ppt/": pptx_text}
    return readers[kind](content) if kind in readers else ""


def collect_tree_text(node: object) -> str:
    """Texts of a tree of {text, children}, each once, in order."""
    if isinstance(node, str):
        return node
    if isinstance(node, list):
        return "\n".join(filter(None, map(collect_tree_text, node)))
    if isinstance(node, dict):
        own = node.get("text")
        return own if isinstance(own, str) and own.strip() else collect_tree_text(node.get("children") or [])
    return ""


def extract_texts(files: DataFrame, pdf: Callable[[bytes], str] | None = None, scan: Callable[[bytes], str] | None = None) -> DataFrame:
    """(path, mime, text) of files by their real type.

    pdf gives a PDF's own text, scan recognises characters in images and in PDFs with too few
    words of their own; without them such files have no text. Anything unknown is read as UTF-8.
    """

    @F.pandas_udf("string")
    def office(contents: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([_office_text(c, k) for c, k in zip(contents, kinds)], dtype=object)

    def run(f: Callable[[bytes], str] | None):
        @F.pandas_udf("string")
        def call(contents: pd.Series) -> pd.Series:
            return pd.Series([f(c) if f and c else "" for c in contents], dtype=object)

        return call

    typed = files.withColumn("mime", file_type(F.col("content"))["mime"]).withColumn("kind", package_kind(F.when(F.startswith("mime", F.lit(_OOXML)), F.col("content"))))
    parts = [
        typed.where(F.startswith("mime", F.lit(_OOXML))).withColumn("text", office("content", "kind")),
        typed.where("mime is null").withColumn("text", F.try_validate_utf8("content")),
        typed.where(F.startswith("mime", F.lit("image/"))).withColumn("text", run(scan)("content")),
    ]
    native = typed.where("mime = 'application/pdf'").withColumn("own", run(pdf)("content"))
    enough = word_count(F.col("own")) >= NATIVE_WORDS
    scanned = native.withColumn("seen", run(scan)(F.when(~enough, F.col("content"))))
    parts.append(scanned.withColumn("text", F.when(enough | (F.coalesce("seen", F.lit("")) == ""), F.col("own")).otherwise(F.col("seen"))))
    united = reduce(DataFrame.unionByName, [p.select("path", "mime", "text") for p in parts])
    return united.withColumn("text", clean_text(F.coalesce("text", F.lit(""))))


def best_scan(candidates: DataFrame) -> DataFrame:
    """The best recognised variant of each image: (path, variant, text, confidence)."""
    score = F.col("confidence") + 0.4 * F.least(word_count(F.col("text")), F.lit(250)) + 0.01 * F.least(F.length("text"), F.lit(2000))
    best = F.max_by(F.struct("variant", "text", "confidence"), F.struct(score, -F.col("variant")))
    return candidates.groupBy("path").agg(best.alias("b")).select("path", "b.*")


def register_uploads(files: DataFrame, owner: Column, now: Column, folder: Column | None = None) -> dict[str, DataFrame]:
    """What an upload of (path, mime, content) writes: documents, jobs and audit.

    A file's type is told by its first bytes, the given one standing where they tell nothing; its
    name takes the extension that fits. An image gets the name of a one-page preview. Every document
    starts as pending, is queued for extraction and logged.
    """
    found = file_type(F.col("content"))
    typed = files.withColumn("__type", found).withColumn("__name", F.element_at(F.split("path", "/"), -1))
    mime = F.coalesce("__type.mime", "mime")
    bare = F.regexp_replace("__name", r"\.[^.]*$", "")
    name = F.when(F.col("__type").isNotNull(), F.concat(bare, "__type.extension")).otherwise(F.col("__name"))
    image = F.startswith(F.coalesce(mime, F.lit("")), F.lit("image/"))
    documents = typed.select(
        F.sha2(F.concat_ws("|", owner.cast("string"), "path"), 256).alias("document_id"), owner.alias("owner_id"),
        (F.lit(None).cast("string") if folder is None else folder).alias("folder_id"), name.alias("filename"), F.col("__name").alias("original_name"),
        mime.alias("mime"), F.octet_length("content").cast("bigint").alias("size"), F.when(image, F.concat(bare, F.lit(".preview.pdf"))).alias("preview"),
        F.when(image, 1).alias("page_count"), F.lit("pending").alias("status"), now.alias("created_at"),
    )
    jobs = documents.select("document_id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("seq"), F.lit(0).alias("attempt"))
    audit = documents.select(
        F.col("owner_id").alias("user_id"), F.lit("DOCUMENT_UPLOAD").alias("action"), F.lit("Document").alias("resource_type"),
        F.col("document_id").alias("resource_id"), F.to_json(F.struct(F.col("original_name").alias("filename"), "size")).alias("metadata"),
    )
    return {"documents": documents, "jobs": jobs, "audit": audit}
