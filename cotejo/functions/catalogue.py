"""The catalogue of levels as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cotejo import config
from cotejo.functions.text import once

#: Longest keys first, so the first that fits is the longest.
KEYS = sorted(config.LEVELS, key=lambda k: (-len(k), k))


def _fitting(key: Column, value: Callable[[str], Column]) -> Column:
    """value of the longest catalogue key that is the title or its beginning; null for exceptions and unknown titles."""

    def first(padded: Column) -> Column:
        found = F.when(padded.isin(*[f"{e} " for e in config.EXCEPTIONS]), None)
        for k in KEYS:
            found = found.when(F.startswith(padded, F.lit(f"{k} ")), value(k))
        return found

    return once(F.concat(key, F.lit(" ")), first)


def category(key: Column) -> Column:
    """The catalogue key that fits a title, with aliases resolved."""
    return _fitting(key, lambda k: F.lit(config.ALIASES.get(k, k)))


def specific_name(key: Column) -> Column:
    """What follows the category, or the whole title without one."""
    return once(key, lambda t: F.coalesce(_fitting(t, lambda k: F.trim(F.substring(t, len(k) + 1, 1 << 30))), t))


def display(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in config.DISPLAY.items() for x in pair])
    return F.try_element_at(table, kind)


def levels(kind: Column) -> Column:
    """Valid levels of a category; none for null."""
    table = F.create_map(*[x for k, v in config.LEVELS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.try_element_at(table, kind), F.array().cast("array<int>"))


def level_state(kind: Column, level: Column) -> Column:
    """State of a normalised level in its category."""
    number = F.regexp_extract(F.coalesce(level, F.lit("")), r"^N(\d+)$", 1)
    told = lambda k, n: F.when(k.isNull(), "TIPO_NO_RECONOCIDO").when(n == "", "NO_ENCONTRADO").when(F.array_contains(levels(k), n.try_cast("int")), "VALIDO").otherwise("FUERA_DE_CATALOGO")
    return once(kind, lambda k: once(number, lambda n: told(k, n)))


def warning(normalised: Column, level: Column) -> Column:
    """A message for a level outside the catalogue, by the normalised title as written (abbreviations not expanded)."""

    def told(kind: Column) -> Column:
        names = F.array_join(F.transform(levels(kind), lambda n: F.concat(F.lit("N"), n.cast("string"))), " o ")
        message = F.concat(F.lit("Nivel "), level, F.lit(" no coincide con el catálogo esperado para '"), kind, F.lit("' (se esperaba "), names, F.lit(")."))
        return F.when(level_state(kind, level) == "FUERA_DE_CATALOGO", message)

    return once(category(normalised), told)
