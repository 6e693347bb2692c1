"""Spreadsheets (.xlsx, .xlsm) and word-processor documents (.docx) as data sources of Spark.

Format ``workbook_rows`` reads workbooks, ``document_rows`` the tables of documents.  Small files share a partition, a large workbook has one
for each sheet.  The XML of a part is read as a stream, so a task holds a row or a table at a time and the shared texts of
one workbook.  Whatever goes wrong with a file, it is one row with its error, and the others are read.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from cotejo.plans.saved import saved

#: A row for each sheet, each cell that holds a value, each merged range (row and col to last_row and last_col) and each error.
WORKBOOK_ROWS = "file string, sheet string, sheet_no int, kind string, row int, col int, last_row int, last_col int, value string, error string"
#: A row for each row of a table, with the texts of its cells; a merged cell's text stands in each place that it covers.
DOC_ROWS = "file string, table_idx int, row_idx int, cells array<string>, error string"
#: Bytes of small files that share a partition; workbooks of more have a partition for each sheet.
SHARED_BYTES = 16 << 20
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_LINKS = ("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id", "{http://purl.oclc.org/ooxml/officeDocument/relationships}id")


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def place(reference: str) -> tuple[int, int]:
    """Row and column of a reference such as BC12."""
    m = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", reference)
    if not m:
        raise ValueError(f"no cell reference: {reference}")
    return int(m[2]), column_number(m[1])


def _bare(tag: str) -> str:
    return tag.rpartition("}")[2]


def _texts(element: ElementTree.Element, tag: str) -> str:
    """The texts below element of that tag; phonetic guides aren't text."""
    if _bare(element.tag) == "rPh":
        return ""
    return (element.text or "") if _bare(element.tag) == tag else "".join(_texts(e, tag) for e in element)


def sheets(z: zipfile.ZipFile) -> list[tuple[str, int, str]]:
    """Name, place and part of each sheet of a workbook."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    found = []
    for s in (e for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _bare(e.tag) == "sheet"):
        target = targets[next(s.get(a) for a in _LINKS if s.get(a))]
        found.append((s.get("name"), len(found), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return found


def shared_texts(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    out = []
    with z.open("xl/sharedStrings.xml") as f:
        for _, e in ElementTree.iterparse(f):
            if _bare(e.tag) == "si":
                out.append("".join(_texts(t, "t") for t in e))
                e.clear()
    return out


def sheet_rows(z: zipfile.ZipFile, part: str, shared: list[str], columns: set[int] | None = None) -> Iterator[tuple]:
    """(kind, row, col, last_row, last_col, value) of a sheet's cells (of some columns) and merged ranges.

    Formulas give their stored results.  A row or cell without a reference is the one behind the last.
    """
    row = col = 0
    with z.open(part) as f:
        for event, e in ElementTree.iterparse(f, ("start", "end")):
            tag = _bare(e.tag)
            if event == "start":
                if tag == "row":
                    row, col = int(e.get("r") or row + 1), 0
                elif tag == "sheetData":
                    holder = e
            elif tag == "c":
                row, col = place(e.get("r")) if e.get("r") else (row, col + 1)
                kind, v = e.get("t", "n"), next((x for x in e if _bare(x.tag) == "v"), None)
                if kind == "inlineStr":
                    value = "".join(_texts(x, "t") for x in e if _bare(x.tag) == "is")
                elif v is None or v.text is None:
                    continue
                else:
                    value = shared[int(v.text)] if kind == "s" else {"1": "True", "0": "False"}.get(v.text, v.text) if kind == "b" else v.text
                if columns is None or col in columns:
                    yield "cell", row, col, None, None, value
            elif tag == "row":
                holder.clear()  # rows that are read go
            elif tag == "mergeCell":
                ends = [place(x) for x in e.get("ref").split(":")]
                yield "merged", *ends[0], *ends[-1], None


def _paragraph(p: ElementTree.Element) -> str:
    """A paragraph's text; tabs and breaks count, what is deleted doesn't."""
    out = []
    for e in p.iter():
        if e.tag == f"{_WORD}t":
            out.append(e.text or "")
        elif e.tag == f"{_WORD}tab" and e.get(f"{_WORD}val") is None and e.get(f"{_WORD}pos") is None:
            out.append("\t")
        elif e.tag in (f"{_WORD}br", f"{_WORD}cr"):
            out.append("\n")
    return "".join(out)


def table_rows(table: ElementTree.Element) -> Iterator[list[str]]:
    """Cell texts of a table's rows, one for each column of its grid: a cell that spans columns or goes on downwards stands in each place; tables in a cell are left out."""
    above: list[str] = []
    for tr in table.findall(f"{_WORD}tr"):
        properties = tr.find(f"{_WORD}trPr")
        before = properties.find(f"{_WORD}gridBefore") if properties is not None else None
        skipped = int(before.get(f"{_WORD}val") or 0) if before is not None else 0
        cells: list[str] = []
        for tc in tr.findall(f"{_WORD}tc"):
            about = tc.find(f"{_WORD}tcPr")
            span = about.find(f"{_WORD}gridSpan") if about is not None else None
            merge = about.find(f"{_WORD}vMerge") if about is not None else None
            at = skipped + len(cells)
            text = "\n".join(_paragraph(p) for p in tc.findall(f"{_WORD}p"))
            if merge is not None and merge.get(f"{_WORD}val", "continue") == "continue" and at < len(above):
                text = above[at]
            cells += [text] * max(1, int(span.get(f"{_WORD}val") or 1) if span is not None else 1)
        above = [""] * skipped + cells
        yield cells


def document_tables(z: zipfile.ZipFile) -> Iterator[tuple[int, int, list[str]]]:
    """Table (from 0), row (from 1) and cell texts of the tables that stand in a document's body, table by table."""
    number, open_tags = 0, []
    with z.open("word/document.xml") as f:
        for event, e in ElementTree.iterparse(f, ("start", "end")):
            if event == "start":
                open_tags.append(e.tag)
                continue
            open_tags.pop()
            if open_tags[-1:] == [f"{_WORD}body"]:
                if e.tag == f"{_WORD}tbl":
                    for r, cells in enumerate(table_rows(e), 1):
                        yield number, r, cells
                    number += 1
                e.clear()


class Files(InputPartition):
    """Files of a partition, or the sheet of one."""

    def __init__(self, paths: list[str], sheet_no: int | None = None) -> None:
        self.paths, self.sheet_no = paths, sheet_no


def _error(e: BaseException) -> str:
    return f"{type(e).__name__}: {e}"


class FileReader(DataSourceReader):
    """Deals the files below a path out to partitions."""

    endings: tuple[str, ...] = ()

    def __init__(self, options: dict) -> None:
        self.path = options.get("path")
        if not self.path:
            raise ValueError("a path is needed")
        self.files, inside = pyarrow.fs.FileSystem.from_uri(self.path) if re.match(r"\w+:", self.path) else (pyarrow.fs.LocalFileSystem(), self.path)
        self.inside = inside.rstrip("/") or "/"

    def _listed(self) -> list[tuple[str, int]]:
        about = self.files.get_file_info(self.inside)
        if about.type == pyarrow.fs.FileType.File:
            return [(about.path, about.size)]
        found = self.files.get_file_info(pyarrow.fs.FileSelector(self.inside, recursive=True))
        return sorted((x.path, x.size) for x in found if x.type == pyarrow.fs.FileType.File and x.path.lower().endswith(self.endings) and not x.base_name.startswith(("~$", ".", "_")))

    def _large(self, path: str) -> list[Files]:
        return [Files([path])]

    def partitions(self) -> list[Files]:
        out, some, size = [], [], 0
        for path, n in self._listed():
            if n > SHARED_BYTES:
                out += self._large(path)
                continue
            if some and size + n > SHARED_BYTES:
                out.append(Files(some))
                some, size = [], 0
            some, size = [*some, path], size + n
        return [*out, Files(some)] if some or not out else out


class WorkbookReader(FileReader):
    endings = (".xlsx", ".xlsm")

    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.names = {options["sheet"]} if options.get("sheet") else None
        self.kinds: set[str] | None = None
        self.columns: set[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Sheets, kinds and columns of cells that aren't asked for are not read; Spark filters as well."""
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            for column, name in (("sheet", "names"), ("kind", "kinds"), ("col", "columns")):
                if wanted is not None and f.attribute == (column,):
                    have = getattr(self, name)
                    setattr(self, name, wanted if have is None else have & wanted)
            yield f

    def _large(self, path: str) -> list[Files]:
        try:
            with self.files.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                return [Files([path], no) for _, no, _ in sheets(z)]
        except Exception:  # told by the task that reads it
            return [Files([path])]

    def _rows(self, path: str, sheet_no: int | None) -> Iterator[tuple]:
        with self.files.open_input_file(path) as f, zipfile.ZipFile(f) as z:
            shared: list[str] | None = None
            for name, no, part in sheets(z):
                if sheet_no not in (None, no):
                    continue
                yield path, name, no, "sheet", None, None, None, None, None, None
                if self.names is not None and name not in self.names:
                    continue
                if self.kinds is not None and not self.kinds & {"cell", "merged"}:
                    continue
                if shared is None:
                    shared = shared_texts(z)
                for kind, row, col, last_row, last_col, value in sheet_rows(z, part, shared, self.columns):
                    yield path, name, no, kind, row, col, last_row, last_col, value, None

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            try:
                yield from self._rows(path, partition.sheet_no)
            except Exception as e:
                yield path, None, None, "error", None, None, None, None, None, _error(e)


class DocumentReader(FileReader):
    endings = (".docx",)

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            try:
                with self.files.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                    for table, row, cells in document_tables(z):
                        yield path, table, row, cells, None
            except Exception as e:
                yield path, None, None, None, _error(e)


class WorkbookSource(DataSource):
    """Rows of the workbooks at or below ``path``; option sheet: cells and ranges of one sheet alone (all sheets are listed)."""

    @classmethod
    def name(cls) -> str:
        return "workbook_rows"

    def schema(self) -> str:
        return WORKBOOK_ROWS

    def reader(self, schema) -> DataSourceReader:
        return WorkbookReader(self.options)


class DocumentSource(DataSource):
    """Table rows of the documents at or below ``path``."""

    @classmethod
    def name(cls) -> str:
        return "document_rows"

    def schema(self) -> str:
        return DOC_ROWS

    def reader(self, schema) -> DataSourceReader:
        return DocumentReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the formats known to the session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WorkbookSource)
    spark.dataSource.register(DocumentSource)


def _whole(rows: DataFrame) -> DataFrame:
    """rows without those of files that have an error, but for one error of each."""
    errors = rows.where("error IS NOT NULL").withColumn("_first", F.row_number().over(Window.partitionBy("file").orderBy("error"))).where("_first = 1").drop("_first")
    return rows.join(errors.select("file"), "file", "left_anti").unionByName(errors)


def read_workbooks(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """WORKBOOK_ROWS of all workbooks at or below path, of one sheet's cells if it is named, read once and saved.

    A file that breaks off anywhere is one row with its error.  ValueError if readable workbooks are there and none has that sheet.
    """
    register(spark)
    reader = spark.read.format("workbook_rows")
    rows = _whole(saved((reader.option("sheet", sheet) if sheet else reader).load(path)))
    if sheet is not None:
        told = rows.where("kind = 'sheet'").agg(F.count("*").alias("n"), F.count_if(F.col("sheet") == sheet).alias("found"), F.sort_array(F.collect_set("sheet")).alias("names")).first()
        if told["n"] and not told["found"]:
            raise ValueError(f"Análisis incompleto: la hoja '{sheet}' no existe. Hojas disponibles: {', '.join(told['names'])}.")
    return rows


def read_doc_rows(spark: SparkSession, path: str) -> DataFrame:
    """DOC_ROWS of all documents at or below path, read once and saved."""
    register(spark)
    return _whole(saved(spark.read.format("document_rows").load(path)))
