"""Files of many formats to one grid of cells: delimited text, JSON record lists, pipe tables, workbooks, documents, archives.

Files come through Spark's ``binaryFile`` scan, one row each, and are unfolded in tasks; every file that cannot be read
becomes a gap row with its reason instead of failing the job. Archives are unfolded first, with guards against paths that
leave the archive, vendored directories and sizes beyond the limits.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Directories of archives that hold other people's code or no text.
SKIPPED_DIRECTORIES = {"node_modules", ".git", "vendor", "dist", "build", "__pycache__", ".venv", "venv", "target", "bin", "obj"}
MAX_MEMBERS, MAX_BYTES = 2000, 200 * 1024 * 1024

_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
Row = tuple[str, int, list[str]]


def read_delimited(spark: SparkSession, path: str, schema: str, separator: str = ",") -> DataFrame:
    """Delimited text with a header by Spark's own reader: quoted line feeds are kept, cells stripped, and a record that does not fit
    the schema is kept whole in ``_gap`` (null for the others)."""
    reader = spark.read.schema(f"{schema}, _gap string").option("header", True).option("sep", separator).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_gap")
    return reader.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("encoding", "UTF-8").csv(path)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON records, one a line or as lists, by Spark's own reader; what is no record is kept in ``_gap``."""
    return spark.read.schema(f"{schema}, _gap string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_gap").json(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): every text file below a folder as one row."""
    return spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def dispatched(spark: SparkSession, path: str) -> DataFrame:
    """(path, format, n_bytes): files below a folder by the reader that is due to them: by what their first bytes say, else by their ending."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    magic, name = F.hex(F.substring("content", 1, 4)), F.lower("path")
    ending = F.regexp_extract(name, r"\.([a-z0-9]+)$", 1)
    kind = (
        F.when(magic == "D0CF11E0", "old office").when(magic == "25504446", "pdf").when((magic == "504B0304") & ending.isin("xlsx", "docx"), ending).when(magic == "504B0304", "archive")
        .when(ending.isin("csv", "tsv"), "delimited").when(ending.isin("json", "jsonl"), "records").otherwise("text")
    )
    return files.select("path", kind.alias("format"), F.col("length").alias("n_bytes"))


def scan(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, content) of every file under ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")


def _decoded(content: bytes) -> str:
    return content.decode("utf-8-sig", errors="replace")


def csv_rows(content: bytes) -> Iterator[Row]:
    text = _decoded(content)
    head = text.partition("\n")[0]
    separator = max(",;\t", key=head.count)
    for i, cells in enumerate(csv.reader(io.StringIO(text), delimiter=separator)):
        if any(c.strip() for c in cells):
            yield "", i, [c.strip() for c in cells]


def _record_list(node: object) -> list[dict] | None:
    """The first list of objects: at the top, among the children, then deeper."""
    if isinstance(node, list):
        return node if node and all(isinstance(x, dict) for x in node) else next((r for x in node if (r := _record_list(x))), None)
    if isinstance(node, dict):
        direct = [v for v in node.values() if isinstance(v, list) and v and all(isinstance(x, dict) for x in v)]
        return direct[0] if direct else next((r for v in node.values() if (r := _record_list(v))), None)
    return None


def json_rows(content: bytes) -> Iterator[Row]:
    records = _record_list(json.loads(_decoded(content)))
    if records is None:
        raise ValueError("no list of records")
    header = list(dict.fromkeys(k for r in records for k in r))
    yield "", 0, header
    for i, r in enumerate(records, 1):
        yield "", i, ["" if r.get(k) is None else str(r[k]) for k in header]


def pipe_rows(content: bytes) -> Iterator[Row]:
    """Rows of the pipe tables of a text; each table is a sheet."""
    table = row = 0
    for line in [*_decoded(content).splitlines(), ""]:
        if line.strip().startswith("|"):
            cells = [c.strip() for c in line.strip().strip("|").split("|")]
            if not all(re.fullmatch(":?-+:?", c) for c in cells):
                yield f"table {table}", row, cells
                row += 1
        elif row:
            table, row = table + 1, 0


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", reference).group():
        n = n * 26 + ord(c) - 64
    return max(n - 1, 0)


def xlsx_rows(content: bytes) -> Iterator[Row]:
    """Visible sheets of a workbook; merged ranges carry their first value, blank rows are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        strings = []
        if "xl/sharedStrings.xml" in names:
            strings = ["".join(t.text or "" for t in si.iter(f"{_SHEET}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_SHEET}sheet"):
            if sheet.get("state", "visible") != "visible":
                continue
            root = ElementTree.fromstring(z.read("xl/" + targets[sheet.get(_RELATION)].removeprefix("/xl/")))
            grid: dict[tuple[int, int], str] = {}
            for r, row in enumerate(root.iter(f"{_SHEET}row")):
                number = int(row.get("r", r + 1)) - 1
                for k, cell in enumerate(row.iter(f"{_SHEET}c")):
                    at = _column(cell.get("r", "")) if cell.get("r") else k
                    value = cell.findtext(f"{_SHEET}v")
                    if cell.get("t") == "s" and value is not None:
                        value = strings[int(value)]
                    elif cell.get("t") == "inlineStr":
                        value = "".join(t.text or "" for t in cell.iter(f"{_SHEET}t"))
                    if value and value.strip():
                        grid[number, at] = value.strip()
            for merged in root.iter(f"{_SHEET}mergeCell"):
                a, _, b = merged.get("ref").partition(":")
                rows = [int(re.sub("[A-Z]", "", x)) - 1 for x in (a, b)]
                cols = [_column(x) for x in (a, b)]
                if (value := grid.get((rows[0], cols[0]))) is not None:
                    grid |= {(r, c): value for r in range(rows[0], rows[1] + 1) for c in range(cols[0], cols[1] + 1)}
            width = 1 + max((c for _, c in grid), default=-1)
            for r in sorted({r for r, _ in grid}):
                yield sheet.get("name", ""), r, [grid.get((r, c), "") for c in range(width)]


def uncached_formulas(content: bytes) -> dict[str, int]:
    """Per part of a workbook: cells that hold a formula and no value."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = [n for n in z.namelist() if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)]
        counts = {n: sum(c.find(f"{_SHEET}f") is not None and not c.findtext(f"{_SHEET}v") for c in ElementTree.fromstring(z.read(n)).iter(f"{_SHEET}c")) for n in parts}
    return {n: k for n, k in counts.items() if k}


def docx_rows(content: bytes) -> Iterator[Row]:
    """Paragraphs as rows of one cell and table rows as rows of theirs, in the order of the body."""
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{_WORD}t")).strip()
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")
    n = table = 0
    for node in body:
        if node.tag == f"{_WORD}p" and text(node):
            yield "", n, [text(node)]
            n += 1
        elif node.tag == f"{_WORD}tbl":
            for row in node.iter(f"{_WORD}tr"):
                yield f"table {table}", n, [text(c) for c in row.iter(f"{_WORD}tc")]
                n += 1
            table += 1


READERS = {".csv": csv_rows, ".tsv": csv_rows, ".json": json_rows, ".md": pipe_rows, ".txt": pipe_rows, ".xlsx": xlsx_rows, ".docx": docx_rows}
_MEMBERS = pa.schema([("path", pa.string()), ("content", pa.binary()), ("gap", pa.string())])
_GRID = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("row_no", pa.int32()), ("cells", pa.list_(pa.string())), ("gap", pa.string())])


def archive_members(content: bytes) -> Iterator[tuple[str, bytes]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        total = 0
        for k, info in enumerate(i for i in z.infolist() if not i.is_dir()):
            parts = info.filename.replace("\\", "/").split("/")
            if info.filename.startswith("/") or ".." in parts or re.match("[A-Za-z]:", parts[0]):
                raise ValueError(f"path leaves the archive: {info.filename[:80]}")
            if SKIPPED_DIRECTORIES & set(parts[:-1]):
                continue
            total += info.file_size
            if k >= MAX_MEMBERS or total > MAX_BYTES:
                raise ValueError("archive beyond the limits")
            yield "/".join(parts), z.read(info)


def unfolded(files: DataFrame) -> DataFrame:
    """(path, content, gap): archives replaced by their members (``archive.zip!member``), other files as they are."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                if not path.lower().endswith(".zip"):
                    rows.append((path, content, None))
                    continue
                try:
                    rows += [(f"{path}!{name}", data, None) for name, data in archive_members(content)]
                except (ValueError, zipfile.BadZipFile, RuntimeError) as e:
                    rows.append((path, None, str(e)[:200]))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _MEMBERS, strict=True)], schema=_MEMBERS)

    return files.select("path", "content").mapInArrow(batches, "path string, content binary, gap string")


def grid(files: DataFrame) -> DataFrame:
    """(path, sheet, row_no, cells, gap) of every file that has a reader; files that cannot be read give one row with the gap."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for path, content, gap in zip(*(b.column(c).to_pylist() for c in ("path", "content", "gap")), strict=True):
                reader = next((r for s, r in READERS.items() if path.lower().endswith(s)), None)
                if gap or reader is None:
                    rows.append((path, "", -1, None, gap or "no reader for this kind of file"))
                    continue
                try:
                    found = [(path, s, n, cells, None) for s, n, cells in reader(content or b"")]
                    rows += found or [(path, "", -1, None, "no rows")]
                    if reader is xlsx_rows:
                        rows += [(path, part, -1, None, f"{n} formulas without a value") for part, n in uncached_formulas(content or b"").items()]
                except Exception as e:  # one unreadable file must not end the job
                    rows.append((path, "", -1, None, f"{type(e).__name__}: {e}"[:200]))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _GRID, strict=True)], schema=_GRID)

    return unfolded(files).mapInArrow(batches, "path string, sheet string, row_no int, cells array<string>, gap string")


def gaps_beyond(rows: DataFrame, group: str, number: str, most: int) -> DataFrame:
    """(group, n_rows, n_beyond): rows of each file or sheet, and those past the limit that a reader with a cap would not give; nothing is dropped."""
    return rows.groupBy(group).agg(F.count("*").alias("n_rows"), F.count_if(F.col(number) > most).alias("n_beyond")).where("n_beyond > 0")
