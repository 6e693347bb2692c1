"""Workbooks as a data source that Spark writes to.

Format ``workbook`` writes a file for each partition, all or none: tasks write to a folder of the job beside the path, the commit
moves what they wrote to its place, an abort deletes it.  A file has the partition's rows in one sheet, coloured by a column that
isn't shown, with a bold header that stays in view, a filter and widths by content, and a sheet of summary lines if there are some.
"""

from __future__ import annotations

import io
import json
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape

import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Rows and columns that a sheet can hold, the header included.
SHEET_ROWS, SHEET_COLUMNS = 1_048_576, 16_384
# The header's colours, and the least and largest width of a column.
HEAD_FILL, HEAD_FONT = "44546A", "FFFFFF"
NARROW, WIDE = 12, 60
#: Styles of summary lines.
STYLES = ("", "bold", "title", "section")
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_NO_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff\ud800-\udfff]")


def letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _cell(row: int, column: int, value: object, style: int = 0) -> str:
    at = f'r="{letters(column)}{row}"' + (f' s="{style}"' if style else "")
    if value is None:
        return f"<c {at}/>" if style else ""
    if isinstance(value, (int, float)) and not isinstance(value, bool) and value == value and abs(value) != float("inf"):
        return f"<c {at}><v>{value}</v></c>"
    return f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(_NO_XML.sub("", str(value)))}</t></is></c>'


def _line(row: int, values: Iterable, style: int = 0) -> bytes:
    return (f'<row r="{row}">' + "".join(_cell(row, c, v, style) for c, v in enumerate(values, 1)) + "</row>").encode()


def _styles(colours: list[str]) -> str:
    """Styles 1 to 4 are the header's, bold, the title's and a section's; those behind them fill a cell with a colour."""
    fonts = ["", "<b/>", f'<b/><color rgb="FF{HEAD_FONT}"/>', '<b/><sz val="14"/>', '<b/><sz val="12"/>']
    fills = ['<patternFill patternType="none"/>', '<patternFill patternType="gray125"/>', *(f'<patternFill patternType="solid"><fgColor rgb="FF{c}"/></patternFill>' for c in (HEAD_FILL, *colours))]
    formats = ['<xf fontId="0" fillId="0" borderId="0"/>', '<xf fontId="2" fillId="2" borderId="0" applyFont="1" applyFill="1" applyAlignment="1"><alignment horizontal="center" vertical="center" wrapText="1"/></xf>']
    formats += [f'<xf fontId="{f}" fillId="0" borderId="0" applyFont="1"/>' for f in (1, 3, 4)] + [f'<xf fontId="0" fillId="{i}" borderId="0" applyFill="1"/>' for i in range(3, 3 + len(colours))]
    group = lambda name, items: f'<{name} count="{len(items)}">{"".join(items)}</{name}>'
    return f'<styleSheet xmlns="{_MAIN}">{group("fonts", [f"<font>{x}</font>" for x in fonts])}{group("fills", [f"<fill>{x}</fill>" for x in fills])}<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>{group("cellXfs", formats)}</styleSheet>'


def _head(widths: list[int], frozen: bool) -> bytes:
    views = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>' if frozen else ""
    columns = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths, 1))
    return f'<worksheet xmlns="{_MAIN}">{views}{f"<cols>{columns}</cols>" if columns else ""}<sheetData>'.encode()


def _width(longest: int) -> int:
    return min(max(longest + 2, NARROW), WIDE)


class TooManyRows(ValueError):
    pass


def write_file(out, header: list[str], rows: Iterator[tuple[str | None, tuple]], name: str = "Detalle", summary: list[tuple[str, list]] | None = None, summary_name: str = "Resumen") -> int:
    """Writes a workbook of rows (colour, values) to a binary file; summary has (style, values) lines.  The number of rows; TooManyRows beyond a sheet.

    Rows are kept compressed until all are there, since a sheet's widths stand before them.
    """
    if len(header) > SHEET_COLUMNS:
        raise ValueError(f"{len(header)} columns, a sheet has {SHEET_COLUMNS}")
    colours: dict[str, int] = {}
    longest = [len(h) for h in header]
    n, held, packer = 1, [], zlib.compressobj(1)
    for colour, values in rows:
        n += 1
        if n > SHEET_ROWS:
            raise TooManyRows(f"over {SHEET_ROWS} rows in a file")
        longest = [m if v is None else max(m, len(str(v))) for m, v in zip(longest, values, strict=True)]
        held.append(packer.compress(_line(n, values, 5 + colours.setdefault(colour, len(colours)) if colour else 0)))
    held.append(packer.flush())
    sheets = [name] + ([summary_name] if summary else [])
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{_KIND}.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{_KIND}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{_KIND}.styles+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/styles.xml", _styles(list(colours)))
        named = "".join(f'<sheet name="{escape(s, {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, s in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_LINKS}"><sheets>{named}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Type="{_LINKS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE}/relationships">{links}<Relationship Id="s" Type="{_LINKS}/styles" Target="styles.xml"/></Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
            f.write(_head([_width(x) for x in longest], True) + _line(1, header, 1))
            opener = zlib.decompressobj()
            for part in held:
                f.write(opener.decompress(part))
            f.write(f'</sheetData><autoFilter ref="A1:{letters(max(1, len(header)))}{n}"/></worksheet>'.encode())
        if summary:
            widths = [max((len(str(v[i])) for _, v in summary if i < len(v) and v[i] is not None), default=0) for i in range(max(len(v) for _, v in summary))]
            z.writestr("xl/worksheets/sheet2.xml", _head([_width(w) for w in widths], False) + b"".join(_line(r, v, STYLES.index(style) + 1 if style else 0) for r, (style, v) in enumerate(summary, 1)) + b"</sheetData></worksheet>")
    return n - 1


@dataclass
class Written(WriterCommitMessage):
    path: str
    partition: int
    rows: int


class WorkbookWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool) -> None:
        path = options.get("path")
        if not path:
            raise ValueError("a path is needed")
        self.files, inside = pyarrow.fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (pyarrow.fs.LocalFileSystem(), path)
        self.path, self.overwrite = inside.rstrip("/"), overwrite
        self.colour, self.sheet = options.get("colour"), options.get("sheet", "Detalle")
        self.summary = [(s, v) for s, v in json.loads(options["summary"])] if options.get("summary") else None
        self.names = schema.names
        self.shown = [i for i, n in enumerate(self.names) if n != self.colour]
        self.work = f"{self.path}.writing-{uuid.uuid4().hex}"
        if not overwrite and self.files.get_file_info(self.path).type != pyarrow.fs.FileType.NotFound:
            raise FileExistsError(self.path)

    def write(self, rows: Iterator[Row]) -> Written:
        at = self.names.index(self.colour) if self.colour else None
        number = TaskContext.get().partitionId()
        self.files.create_dir(self.work, recursive=True)
        own = f"{self.work}/{number:05}-{uuid.uuid4().hex}.xlsx"  # attempts of a task don't meet
        made = io.BytesIO()
        n = write_file(made, [self.names[i] for i in self.shown], ((r[at] if at is not None else None, tuple(r[i] for i in self.shown)) for r in rows), self.sheet, self.summary)
        with self.files.open_output_stream(own) as f:
            f.write(made.getbuffer())
        return Written(own, number, n)

    def commit(self, messages: list[Written | None]) -> None:
        """One file with rows becomes the path itself, several are numbered in the order of partitions in a folder of that name; without rows there is a file of the header."""
        told = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        full = [m for m in told if m.rows] or told[:1]
        about = self.files.get_file_info(self.path).type
        if about == pyarrow.fs.FileType.Directory:
            self.files.delete_dir(self.path)
        elif about == pyarrow.fs.FileType.File:
            self.files.delete_file(self.path)
        if len(full) == 1:
            self.files.move(full[0].path, self.path)
        elif full:
            self.files.create_dir(self.path, recursive=True)
            for i, m in enumerate(full, 1):
                self.files.move(m.path, f"{self.path}/part-{i:05}.xlsx")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        if self.files.get_file_info(self.work).type == pyarrow.fs.FileType.Directory:
            self.files.delete_dir(self.work)


class WorkbookTarget(DataSource):
    """Writes workbooks to ``path``.  Options: sheet (its name), colour (a column of six hexadecimal digits, not shown), summary (lines as JSON)."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return WorkbookWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session."""
    spark.dataSource.register(WorkbookTarget)
