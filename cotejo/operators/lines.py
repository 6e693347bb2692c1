"""Positions in lines of text: patterns with a wait for wrapped lines, and what is cut from boxes."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo import config
from cotejo.functions.text import normalised, once

# A quantity, a title and a level; a title and a level; the least length of a title.
COUNTED = re.compile(r"^\s*(\d{1,3})\s+(.*[A-Za-zÁÉÍÓÚÑáéíóúñ].*?)\s+(\d{1,3})\s*$")
PLAIN = re.compile(r"^\s*(.*[A-Za-zÁÉÍÓÚÑáéíóúñ]{3,}.*?)\s+(\d{1,3})\s*$")
LEAST = 3
#: What a line that fits either pattern ends in; the patterns themselves are slow on long lines that don't.
TAIL = re.compile(r"\s\d{1,3}\s*$")
NOISE = [re.compile(p) for p in config.DOC_NOISE]
FOUND = "file string, page int, line_no int, cantidad string, puesto_original string, nivel_original string"
_FOUND = pa.schema([(c, pa.int32() if c in ("page", "line_no") else pa.string()) for c in ("file", "page", "line_no", "cantidad", "puesto_original", "nivel_original")])
#: Rows that a task hands on at once.
BATCH = 4096


def _noise(line: str) -> bool:
    if not line.strip():
        return True
    told = normalised(line)  # once for all patterns
    return any(p.search(told) for p in NOISE)


def _read(lines: Iterator[tuple[int, str]]) -> Iterator[tuple]:
    """Rows of FOUND without file and page.

    Noise is passed over.  A line is tried by itself as a counted one, then behind the line that waits.  One that
    begins with a number but is none waits, if none waits already; others are tried as plain ones.
    """
    waiting: tuple[int, str] | None = None
    for no, line in lines:
        line = line.strip()
        if _noise(line):
            continue
        ends = bool(TAIL.search(line))
        m = COUNTED.match(line) if ends else None
        if m:
            waiting = None
        elif waiting and TAIL.search(f" {line}") and (m := COUNTED.match(f"{waiting[1]} {line}")):
            no, waiting = waiting[0], None
        elif waiting is None and re.match(r"^\d{1,3}\s+", line):
            waiting = no, line
            continue
        if m:
            quantity, title, level = m[1], m[2].strip(), m[3]
        elif ends and (m := PLAIN.match(line)):
            quantity, title, level = None, m[1].strip(), m[2]
        else:
            continue
        if len(title) >= LEAST and not _noise(title):
            yield no, quantity, title, level


def pattern_records(lines: DataFrame) -> DataFrame:
    """FOUND of each page's lines (file, page, line_no, text), which are read in order, one after another; a page is in one task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        found = ((*page, *r) for page, own in itertools.groupby(rows, key=lambda r: r[:2]) for r in _read((no, line or "") for _, _, no, line in own))
        while some := list(itertools.islice(found, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), _FOUND, strict=True)], schema=_FOUND)

    dealt = lines.select("file", "page", "line_no", "text").repartition("file", "page").sortWithinPartitions("file", "page", "line_no")
    return dealt.mapInArrow(read, FOUND)


def clean_box(box_text: Column) -> Column:
    """(title, level) of a box: an explicit level is cut out first, else the first number of up to three digits, one of the catalogue's levels before others; doubled halves are one."""
    valid = sorted({n for v in config.LEVELS.values() for n in v})
    explicit = r"(?i)(nivel\s*[:\-]?\s*\d{1,3}|\bn[ivl]*[.\-]?\s*\d{1,3}\b)"
    split = lambda text: F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != "")
    half = lambda rest: F.floor(F.size(rest) / 2).cast("int")
    doubled = lambda rest: (F.size(rest) > 1) & (F.size(rest) % 2 == 0) & (F.slice(rest, F.lit(1), F.greatest(half(rest), F.lit(1))) == F.slice(rest, half(rest) + 1, F.greatest(half(rest), F.lit(1))))
    title = lambda rest: once(rest, lambda r: F.array_join(F.when(doubled(r), F.slice(r, F.lit(1), half(r))).otherwise(r), " "))
    known = lambda numbers: F.filter(numbers, lambda t: t.try_cast("int").isin(*valid))
    number = lambda tokens: once(F.filter(tokens, lambda t: t.rlike(r"^\d{1,3}$")), lambda n: F.coalesce(F.get(known(n), F.lit(0)), F.get(n, F.lit(0))))
    made = lambda rest, level: F.struct(title(rest).alias("title"), level.alias("level"))
    plain = lambda tokens: once(number(tokens), lambda n: made(F.filter(tokens, lambda t: n.isNull() | (t != n)), n))
    cut = lambda text, named: F.when(named != "", made(split(F.regexp_replace(text, explicit, " ")), named)).otherwise(once(split(text), plain))
    return once(box_text, lambda text: once(F.regexp_extract(text, explicit, 1), lambda named: cut(text, named)))
