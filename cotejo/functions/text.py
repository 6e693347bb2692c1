"""Column functions on titles and levels; all are built-in expressions."""

from __future__ import annotations

import re

import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cotejo import config


HANGUL = range(0xAC00, 0xD7A4)


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where value is made once for a row however often then names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _decompositions() -> tuple[str, str, dict[str, str], str]:
    """Compatibility decompositions without combining marks: characters that become one, and these; those that become several; ranges of the marks for a pattern.

    Hangul syllables, which follow a rule, are left out.
    """
    source, target, several, marks = [], [], {}, []
    for code in range(0x80, 0x110000):
        c = chr(code)
        if unicodedata.combining(c):
            if marks and marks[-1][1] == code - 1:
                marks[-1][1] = code
            else:
                marks.append([code, code])
        elif code not in HANGUL and not 0xD800 <= code < 0xE000:
            base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
            if len(base) == 1 and base != c:
                source.append(c)
                target.append(base)
            elif len(base) != 1:
                several[c] = base
    return "".join(source), "".join(target), several, "".join(f"{chr(a)}-{chr(b)}" for a, b in marks)


ACCENTED, PLAIN, SEVERAL, _MARKS = _decompositions()
MARKS = f"[{_MARKS}]"


def _ranges(codes: list[int], gap: int = 16) -> str:
    """Ranges for a pattern that hold the codes; those less than gap apart share one."""
    out: list[list[int]] = []
    for code in sorted(codes):
        if out and code - out[-1][1] <= gap:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in out)


def _unusual() -> tuple[str, str]:
    """Patterns of texts that hold a mark or a character that becomes several: a quick one, which others fit too, and one that few others fit."""
    codes = [*map(ord, SEVERAL), *(c for c in range(0x300, 0x110000) if unicodedata.combining(chr(c))), *HANGUL]
    return f"[{_ranges([c for c in codes if c < 0x300])}\u0300-\U0010ffff]", f"[{_ranges(codes)}]"


QUICK, UNUSUAL = _unusual()
# White space beyond ASCII's that has no decomposition, and ASCII's that patterns don't count.
_SPACES = "\x1c-\x1f\x85\u1680\u2028\u2029"
QUOTES = "‘’“”´`\"'"
DASHES = "–—‒‐‑"


def _expanded(text: Column) -> Column:
    """text with the characters that become several replaced, character by character."""
    table = F.str_to_map(F.lit("\0".join(f"{c}\1{x}" for c, x in SEVERAL.items())), F.lit("\0"), F.lit("\1"))
    first, middle, last = ("".join(map(chr, range(*r))) for r in ((0x1100, 0x1113), (0x1161, 0x1176), (0x11A8, 0x11C3)))

    def one(c: Column) -> Column:
        n = F.ascii(c) - HANGUL[0]
        jamo = lambda of, i: F.substr(F.lit(of), i.cast("int") + 1, F.lit(1))
        syllable = F.concat(jamo(first, F.floor(n / 588)), jamo(middle, F.floor(n % 588 / 28)), F.when(n % 28 > 0, jamo(last, n % 28 - 1)).otherwise(""))
        return F.when(n.between(0, len(HANGUL) - 1), syllable).otherwise(F.coalesce(F.try_element_at(table, c), c))

    return F.array_join(F.transform(F.split(text, ""), one), "")


def strip_accents(text: Column) -> Column:
    """Compatibility characters decomposed and combining marks dropped; texts that hold marks or characters that become several take a slower way."""
    fold = lambda t: F.translate(t, ACCENTED, PLAIN)
    slow = lambda t: F.regexp_replace(fold(_expanded(t)), MARKS, "")
    return once(text, lambda t: F.when(~t.rlike(r"[^\x00-\x7f]"), t).when(t.rlike(QUICK) & t.rlike(UNUSUAL), slow(t)).otherwise(fold(t)))


def normalise_title(text: Column) -> Column:
    """Lower case, no accents, quotes or marks, single spaces; null is empty."""
    told = once(F.coalesce(text.cast("string"), F.lit("")), lambda t: F.when(t.rlike(f"[{QUOTES}{DASHES}]"), F.translate(t, DASHES + QUOTES, "-" * len(DASHES))).otherwise(t))
    plain = F.regexp_replace(F.lower(strip_accents(told)), r"\s*-\s*", "-")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, rf"[^\p{{L}}\p{{N}}_ \s{_SPACES}-]", ""), rf"[\s{_SPACES}]+", " "))


def normalise_level(text: Column) -> Column:
    """N and the level's digits without leading zeros; '' where there is none."""
    plain = F.lower(strip_accents(F.coalesce(text.cast("string"), F.lit(""))))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"nivel\s*", ""), r"^\s*n[-.]?\s*", ""), r"nvl\.?\s*", "")
    digits = F.regexp_extract(plain, r"(\d+)", 1)
    return F.when(digits == "", "").otherwise(F.concat(F.lit("N"), F.regexp_replace(digits, r"^0+(?=\d)", "")))


def words(text: Column) -> Column:
    """Words at spaces of a normalised text; '' has none."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def _abbreviations() -> Column:
    return F.create_map(*[F.lit(x) for pair in config.ABBREVIATIONS.items() for x in pair])


def known_abbreviations(normalised: Column) -> Column:
    """Abbreviations among the words, in order."""
    return F.filter(words(normalised), lambda w: w.isin(*config.ABBREVIATIONS))


_SIGNS = str.maketrans(DASHES, "-" * len(DASHES), QUOTES)
_COMBINING = re.compile(MARKS)


def normalised(title: str) -> str:
    """normalise_title of one string, for readers that go through lines in order."""
    title = re.sub(r"[\r\n\t]+", " ", title or "")
    title = title.translate(_SIGNS)
    if not title.isascii():
        title = _COMBINING.sub("", unicodedata.normalize("NFKD", title))
    title = title.lower()
    title = re.sub(r"[^\w\s-]", "", re.sub(r"\s*-\s*", "-", title))
    return re.sub(r"\s+", " ", title).strip()


def equivalence_note(a: Column, b: Column) -> Column:
    """Which known abbreviations two normalised titles have and what they stand for; '' for none."""
    notes = lambda found: F.array_join(F.transform(found, lambda w: F.concat(F.upper(w), F.lit(" → "), F.try_element_at(_abbreviations(), w))), "; ")
    found = F.array_sort(F.array_distinct(F.concat(known_abbreviations(a), known_abbreviations(b))))
    return once(found, lambda f: F.when(F.size(f) > 0, F.concat(F.lit("Equivalencia aplicada: "), notes(f))).otherwise(""))


def expand_abbreviations(normalised: Column) -> Column:
    table = _abbreviations()
    return F.array_join(F.transform(words(normalised), lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


def homologate(title: Column) -> Column:
    """Titles that begin as a departmental unit or a project leader begin with J.U.D. or L.C.P.; others are untouched."""
    unit = r"(?iu)^\s*(?:(?:jefatura|jefe)\s+de\s+unidad\s+departamental|j\.\s*u\.\s*d\.?|j\s*u\s*d)(?=\s|$)\s*"
    leader = r"(?iu)^\s*(?:l[ií]der\s+coordinador\s+de\s+proyectos|l\.\s*c\.\s*p\.?|l\s*c\s*p)(?=\s|$)\s*"
    short = lambda t, pattern, name: once(F.regexp_replace(t, pattern, ""), lambda rest: F.when(rest == "", name).otherwise(F.concat(F.lit(f"{name} "), rest)))
    return once(F.coalesce(title, F.lit("")), lambda t: F.when(t.rlike(unit), short(t, unit, "J.U.D.")).when(t.rlike(leader), short(t, leader, "L.C.P.")).otherwise(t))


def comparison_key(title: Column) -> Column:
    """The key by which titles are compared: homologated, normalised, abbreviations expanded."""
    return expand_abbreviations(normalise_title(homologate(title)))


def unknown_abbreviation(title: Column) -> Column:
    """A message if the first word looks like an abbreviation that the table doesn't have, else null."""

    def told(first: Column) -> Column:
        looks = first.rlike(r"^([A-ZÁÉÍÓÚÑ]\.){2,6}$") | first.rlike(r"^[A-ZÁÉÍÓÚÑ]{2,6}$")
        message = F.concat(F.lit("'"), first, F.lit("' parece una abreviatura pero no está en el catálogo de equivalencias (config.ABREVIATURAS_PUESTO)."))
        return F.when(looks & ~normalise_title(first).isin(*config.ABBREVIATIONS), message)

    return once(F.element_at(F.split(F.trim(F.coalesce(title, F.lit(""))), r"\s+"), 1), told)


def upper_case_warning(title: Column) -> Column:
    return title != F.upper(title)


def valid_level(level: Column) -> Column:
    return F.coalesce(level.rlike(r"^N\d+$"), F.lit(False))


def suffix(normalised: Column) -> Column:
    """The last word if it is a letter with up to two digits, else null; titles of one word have none."""
    last = lambda ws: F.try_element_at(ws, F.lit(-1))
    return once(words(normalised), lambda ws: F.when((F.size(ws) > 1) & last(ws).rlike(r"^[a-z]\d{0,2}$"), last(ws)))


def modifiers(normalised: Column) -> Column:
    """Modifiers that the title has as whole words, in the settings' order."""
    return once(F.concat(F.lit(" "), normalised, F.lit(" ")), lambda padded: F.array_compact(F.array(*[F.when(F.contains(padded, F.lit(f" {m} ")), m) for m in config.MODIFIERS])))


def is_noise(normalised: Column, patterns: list[str]) -> Column:
    """Blank, or a pattern occurs in the normalised text."""
    return once(normalised, lambda n: reduce(lambda a, b: a | b, [n.rlike(p) for p in patterns], F.trim(n) == ""))


def parse_id(value: Column) -> Column:
    """A positive whole number, else null; written as 11, 11.0 or 1e1."""
    text = F.trim(value.cast("string"))
    number = F.when(text.rlike(r"^[+]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("decimal(38,10)"))
    return F.when((number > 0) & (number == F.floor(number)), number.try_cast("bigint"))


def location(file: Column, sheet: Column | None = None, row: Column | None = None, column: Column | None = None, page: Column | None = None, table: Column | None = None, table_row: Column | None = None, about: Column | None = None) -> Column:
    """Where a record is: the parts that are given and aren't null, joined by bars."""
    named = {"hoja='": sheet, "fila=": row, "col=": column, "pág=": page, "tabla=": table, "fila_tabla=": table_row, "pos≈": about}
    return F.concat_ws(" | ", file, *[F.concat(F.lit(n), c.cast("string"), F.lit("'" if n.endswith("'") else "")) for n, c in named.items() if c is not None])
