"""Word files with a three-column table: scanned to rows, and written again with new target cells.

The parts of a file that matter are found by local names, so any namespace prefix will do.
"""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from collections.abc import Iterator
from copy import deepcopy
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions import lexicon as lx
from rowloom.plans.planner import normalized

# Fixed values.
PART = "word/document.xml"
COLUMNS = 3
HIGHLIGHT = "lightGray"
XML_SPACE = "{http://www.w3.org/XML/1998/namespace}space"
ROWS = "path string, idx int, row_number int, source_text string, target_text string, is_blank boolean, has_script boolean, has_gray boolean, error string"


def local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def own(e: ET.Element, name: str) -> list[ET.Element]:
    return [c for c in e if local(c) == name]


def cell_text(cell: ET.Element) -> str:
    """The cell's text, paragraphs without anything between them."""

    def said(e: ET.Element) -> str:
        name = local(e)
        return "".join(e.itertext()) if name == "t" else {"tab": "\t", "br": "\n"}.get(name) or "".join(map(said, e))

    return normalized("".join(map(said, cell)))


def is_gray(cell: ET.Element) -> bool:
    return any(local(e) == "highlight" and any(k.rpartition("}")[2] == "val" and v == HIGHLIGHT for k, v in e.attrib.items()) for e in cell.iter())


def subtitle_table(root: ET.Element) -> ET.Element | None:
    """The first table that has a row of three cells."""
    tables = (e for e in root.iter() if local(e) == "tbl")
    return next((t for t in tables if any(len(own(r, "tc")) == COLUMNS for r in own(t, "tr"))), None)


def parse(content: bytes) -> list[dict]:
    """The rows of a file. Rows without three cells are left out, but count in ``row_number``."""
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(content)).read(PART))
    table = subtitle_table(root)
    if table is None:
        raise ValueError("no table with rows of three cells")
    out = []
    for number, row in enumerate(own(table, "tr"), 1):
        cells = own(row, "tc")
        if len(cells) == COLUMNS:
            source, target = map(cell_text, cells[1:])
            out.append(
                {
                    "idx": len(out),
                    "row_number": number,
                    "source_text": source,
                    "target_text": target,
                    "is_blank": not source and not target,
                    "has_script": any("؀" <= c <= "ۿ" for c in target),
                    "has_gray": any(map(is_gray, cells[1:])),
                }
            )
    return out


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modificationTime, length, content) of the Word files below a folder. Spark leaves hidden ones out."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[dD][oO][cC][xX]").load(folder)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path): the files that a corpus index names."""
    items = spark.read.schema("items array<struct<copiedPath:string>>").json(path, multiLine=True)
    return items.select(F.explode("items.copiedPath").alias("path")).where("path is not null and path <> ''")


def corpus_files(found: DataFrame, named: DataFrame) -> DataFrame:
    """The files of a corpus: of ``found`` (a listing with ``path``) those that an index names, or all of them if the
    index names none. Names that aren't there are ignored."""
    has_names = F.broadcast(named.agg(F.count("*").alias("n_named")))  # one row
    given = named.select(F.col("path").alias("named_path")).distinct()
    both = found.join(has_names).join(given, F.col("path") == F.col("named_path"), "left")
    return both.where("n_named = 0 or named_path is not null").drop("n_named", "named_path")


def scan(files: DataFrame) -> DataFrame:
    """The rows of all files, a file at a time; a file that can't be read gives one row with ``error`` set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in ROWS.split(", ")]
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows = [r | {"path": path, "error": None} for r in parse(content)]
                except (ValueError, KeyError, zipfile.BadZipFile, ET.ParseError) as e:
                    rows = [dict.fromkeys(names) | {"path": path, "error": str(e) or type(e).__name__}]
                yield pa.RecordBatch.from_pylist(
                    [{n: r[n] for n in names} for r in rows],
                    pa.schema([("path", pa.string()), ("idx", pa.int32()), ("row_number", pa.int32()), ("source_text", pa.string()), ("target_text", pa.string()), ("is_blank", pa.bool_()), ("has_script", pa.bool_()), ("has_gray", pa.bool_()), ("error", pa.string())]),
                )

    return files.select("path", "content").mapInArrow(run, ROWS)


def set_text(cell: ET.Element, text: str) -> None:
    """Replace a cell's content by one paragraph and one run, which keep the first ones' properties."""
    prefix = cell.tag.rpartition("}")[0] + "}" if "}" in cell.tag else ""
    paragraph = next(iter(own(cell, "p")), None)
    run = next(iter(own(paragraph, "r")), None) if paragraph is not None else None
    kept = [next(iter(own(e, name)), None) if e is not None else None for e, name in ((paragraph, "pPr"), (run, "rPr"))]
    for child in [c for c in cell if local(c) != "tcPr"]:
        cell.remove(child)
    new = ET.SubElement(cell, prefix + "p")
    if kept[0] is not None:
        new.append(deepcopy(kept[0]))
    if text:
        r = ET.SubElement(new, prefix + "r")
        if kept[1] is not None:
            r.append(deepcopy(kept[1]))
        t = ET.SubElement(r, prefix + "t")
        t.text = text
        if text[0] in lx.SPACES or text[-1] in lx.SPACES:
            t.set(XML_SPACE, "preserve")


def rewrite(content: bytes, texts: dict[int, str]) -> bytes:
    """The file with the target cells of the given row numbers replaced."""
    old = zipfile.ZipFile(io.BytesIO(content))
    data = old.read(PART)
    for _, (prefix, uri) in ET.iterparse(io.BytesIO(data), events=["start-ns"]):
        ET.register_namespace(prefix, uri)
    root = ET.fromstring(data)
    for number, row in enumerate(own(subtitle_table(root), "tr"), 1):
        cells = own(row, "tc")
        if len(cells) == COLUMNS and number in texts:
            set_text(cells[2], texts[number])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=9) as z:
        for info in old.infolist():
            z.writestr(info.filename, ET.tostring(root, encoding="UTF-8", xml_declaration=True) if info.filename == PART else old.read(info))
    return out.getvalue()


def rewritten(files: DataFrame, rows: DataFrame) -> DataFrame:
    """(path, content): files with the rows (path, row_number, new_text) put in. A sink writes the bytes where it likes;
    a file's rows come together as one array, so memory is bounded by a file."""
    texts = rows.groupBy("path").agg(F.collect_list(F.struct("row_number", "new_text")).alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content, new in zip(*(b.column(c).to_pylist() for c in ("path", "content", "texts")), strict=True):
                made = rewrite(content, {r["row_number"]: r["new_text"] for r in new})
                yield pa.RecordBatch.from_pydict({"path": [path], "content": [made]})

    return files.select("path", "content").join(texts, "path").mapInArrow(run, "path string, content binary")


def output_name(path, suffix: str = "_rearranged", at=None):
    """``path`` with a suffix and a time stamp before its ending; ``at`` is a timestamp column, now by default."""
    at = F.current_timestamp() if at is None else at
    return F.regexp_replace(path, r"^(.*?)(\.[^./\\]*)?$", F.concat(F.lit("$1" + suffix + "_"), F.date_format(at, "MMdd_HHmm"), F.lit("$2")))


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """(path, written_to, size): the sink of ``rewritten``. Each executor writes its files, under their own names, to
    ``folder``, which all of them must have mounted; a file is put in place whole, so that a task may run again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            out = []
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                to = os.path.join(folder, os.path.basename(path))
                with tempfile.NamedTemporaryFile(dir=folder, delete=False) as f:
                    f.write(content)
                os.replace(f.name, to)
                out.append({"path": path, "written_to": to, "size": len(content)})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("written_to", pa.string()), ("size", pa.int64())]))

    return files.select("path", "content").mapInArrow(run, "path string, written_to string, size long")
