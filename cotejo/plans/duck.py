"""The text functions as DuckDB expressions, for the SQL counterparts of queries."""

from __future__ import annotations

from cotejo import config
from cotejo.functions import catalogue, text


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def fold(x: str) -> str:
    return f"translate({x}, {quoted(text.ACCENTED)}, {quoted(text.PLAIN)})"


def title(x: str) -> str:
    x = f"regexp_replace(coalesce({x}, ''), '[\\r\\n\\t]+', ' ', 'g')"
    x = f"translate(translate({x}, {quoted(text.QUOTES)}, ''), {quoted(text.DASHES)}, '-----')"
    x = f"regexp_replace(lower({fold(x)}), '\\s*-\\s*', '-', 'g')"
    return f"trim(regexp_replace(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'), '\\s+', ' ', 'g'))"


def level(x: str) -> str:
    x = f"lower({fold(f'coalesce({x}, {chr(39)}{chr(39)})')})"
    for pattern in (r"nivel\s*", r"^\s*n[-.]?\s*", r"nvl\.?\s*"):
        x = f"regexp_replace({x}, '{pattern}', '', 'g')"
    digits = f"regexp_extract({x}, '(\\d+)', 1)"
    return f"CASE WHEN {digits} = '' THEN '' ELSE 'N' || CAST(CAST({digits} AS HUGEINT) AS VARCHAR) END"


def homologate(x: str) -> str:
    x = f"coalesce({x}, '')"
    out = x
    for short, pattern in (
        ("L.C.P.", r"(?i)^\s*(?:l[ií]der\s+coordinador\s+de\s+proyectos|l\.\s*c\.\s*p\.?|l\s*c\s*p)(?:\s+|$)"),
        ("J.U.D.", r"(?i)^\s*(?:(?:jefatura|jefe)\s+de\s+unidad\s+departamental|j\.\s*u\.\s*d\.?|j\s*u\s*d)(?:\s+|$)"),
    ):
        rest = f"regexp_replace({x}, '{pattern}', '')"
        out = f"CASE WHEN regexp_matches({x}, '{pattern}') THEN CASE WHEN {rest} = '' THEN '{short}' ELSE '{short} ' || {rest} END ELSE {out} END"
    return out


def expand(x: str) -> str:
    cases = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in config.ABBREVIATIONS.items())
    return f"array_to_string(list_transform(list_filter(string_split({x}, ' '), lambda w: w <> ''), lambda w: CASE w {cases} ELSE w END), ' ')"


def key(x: str) -> str:
    return expand(title(homologate(x)))


def _cases(k: str, alias: bool) -> str:
    whens = " ".join(f"WHEN {k} = {quoted(c)} OR starts_with({k}, {quoted(c + ' ')}) THEN {quoted(config.ALIASES.get(c, c) if alias else c)}" for c in catalogue.KEYS)
    return f"CASE WHEN {k} IN ({', '.join(map(quoted, config.EXCEPTIONS))}) THEN NULL {whens} END"


def category(k: str) -> str:
    return _cases(k, True)


def prefix(k: str) -> str:
    return _cases(k, False)


def levels(kind: str) -> str:
    whens = " ".join(f"WHEN {quoted(c)} THEN {v}" for c, v in config.LEVELS.items())
    return f"CASE {kind} {whens} ELSE [] END"


def ratio(a: str, b: str) -> str:
    """Normalised Indel similarity, 0 to 100: the rows of the table of longest common subsequences, one for each character of a."""
    codes = f"list_transform(string_split({a}, ''), lambda c: [ord(c)])"
    step = f"list_transform(range(1, length({b}) + 2), lambda j: CASE WHEN j = 1 THEN 0 ELSE greatest(last[j], CASE WHEN ord(substr({b}, j - 1, 1)) = code[1] THEN last[j - 1] + 1 ELSE 0 END) END)"
    best = f"list_transform([{step}], lambda made: list_transform(range(1, length({b}) + 2), lambda j: list_max(made[1:j])))[1]"
    table = f"list_reduce({codes}, lambda last, code: {best}, list_transform(range(0, length({b}) + 1), lambda j: 0))"
    return f"(200.0 * list_max({table}) / (length({a}) + length({b})))"
