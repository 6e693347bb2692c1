"""Settings: thresholds, catalogue, abbreviations and patterns."""

from __future__ import annotations

# Levels of each catalogue key, in the order of messages.
LEVELS = {
    "jefatura de gobierno": [49],
    "secretaria": [48],
    "subsecretaria": [47],
    "alcaldia": [47],
    "coordinacion general": [47, 46],
    "direccion general": [45, 44],
    "direccion ejecutiva": [43, 42],
    "direccion tecnica": [40, 39],
    "direccion": [40, 39],
    "coordinacion": [34, 32],
    "subdireccion tecnica": [29],
    "subdireccion": [29, 32],
    "jefatura de unidad departamental": [27, 25],
    "jud": [27, 25],
    "lider coordinador de proyectos": [24, 23],
    "lcp": [24, 23],
    "enlace": [21, 20],
}
# Names shown for the keys.
DISPLAY = {
    "jefatura de gobierno": "Jefatura de Gobierno",
    "secretaria": "Secretaría",
    "subsecretaria": "Subsecretaría",
    "alcaldia": "Alcaldía",
    "coordinacion general": "Coordinación General",
    "direccion general": "Dirección General",
    "direccion ejecutiva": "Dirección Ejecutiva",
    "direccion tecnica": "Dirección Técnica",
    "direccion": "Dirección",
    "coordinacion": "Coordinación",
    "subdireccion tecnica": "Subdirección Técnica",
    "subdireccion": "Subdirección",
    "jefatura de unidad departamental": "Jefatura de Unidad Departamental",
    "lider coordinador de proyectos": "Líder Coordinador de Proyectos",
    "enlace": "Enlace",
}
# Keys that stand for another, and whole titles outside the catalogue.
ALIASES = {"jud": "jefatura de unidad departamental", "lcp": "lider coordinador de proyectos"}
EXCEPTIONS = ["secretaria particular", "secretaria tecnica", "secretaria privada"]
# Abbreviations.
ABBREVIATIONS = {
    "jud": "jefatura de unidad departamental",
    "lcp": "lider coordinador de proyectos",
    "dir": "direccion",
    "subdir": "subdireccion",
    "depto": "departamento",
    "dpto": "departamento",
    "coord": "coordinacion",
    "gral": "general",
    "grl": "general",
    "ejec": "ejecutiva",
    "tec": "tecnica",
    "admon": "administracion",
    "rh": "recursos humanos",
    "rrhh": "recursos humanos",
}
# Words that change a title's meaning.
MODIFIERS = ["vice", "adjunto a", "encargado de", "auxiliar de", "asistente de"]
# Thresholds and adjustments of similarity.
HIGH, REVIEW, BONUS, BONUS_FROM, PENALTY = 93, 80, 4, 60, 25
# Headers of spreadsheet columns, normalised; a title or level header need only contain one (the shortest stand for all).
TITLE_HEADERS = ["puesto", "denominacion", "cargo", "estructura propuesta"]
LEVEL_HEADERS = ["nivel"]
ID_HEADERS = ["id", "consecutivo", "numero", "no", "no de puesto", "id puesto", "id del puesto"]
BOSS_HEADERS = ["jefe inmediato", "nombre del jefe inmediato", "puesto del jefe inmediato", "denominacion del puesto del jefe inmediato", "nombre del puesto del jefe inmediato", "denominacion del jefe inmediato", "superior inmediato", "superior jerarquico"]
HEADER_ROWS, FALLBACK_TITLE, FALLBACK_LEVEL, FALLBACK_ID, FALLBACK_BOSS = 30, 10, 11, 9, 12
# Starts of summary rows in a spreadsheet, normalised.
SUMMARY_PREFIXES = ["integro", "titular de unidad administrativa", "titular del area de administracion", "total", "variacion en costo", "no plazas actual", "no plazas propuesta", "variacion en plazas"]
# Headers of document tables, normalised.
DOC_TITLE_HEADERS = ["puesto", "cargo", "denominacion"]
QUANTITY_HEADERS = ["cantidad", "num", "no", "numero", "plazas"]
# Lines of documents and charts that are no positions; matched in the normalised text.
DOC_NOISE = [r"^p[aá]gina\s*\d+", r"^total\s*:?", r"^continua\b", r"^\s*$", r"^cantidad$", r"^denominaci", r"^nivel$", r"^estructura\b", r"^puesto$"]
CHART_NOISE = [r"^anexo\b", r"^organigrama$", r"^oficio\b", r"^folio\b", r"^dictamen\b", r"^dependencia\b", r"^unidad administrativa\b", r"^inicio de vigencia\b", r"^total de plazas\b", r"^d-[a-z]+-\d+"]
# Tolerances of page geometry in points, and the share of the median area that boxes have.
BOX_NEAR, BOX_SLACK, BOX_MARGIN, LINE_NEAR, AREA_LOW, AREA_HIGH = 3.0, 1.0, 2.0, 2.0, 0.2, 6.0

# results' types.
OK, NORMALISED, EQUIVALENT, POSSIBLE = "OK", "Coincide después de normalización", "Coincidencia mediante equivalencia institucional", "Posible coincidencia"
LEVEL_DIFFERS, LEVEL_MISSING, MISSING, EXTRA = "Nivel inconsistente", "Nivel faltante", "Puesto faltante", "Puesto adicional"
DUPLICATE, DUPLICATE_LEVEL, REVISE, ERROR = "Duplicado", "Duplicado con nivel distinto", "Requiere revisión", "Error de extracción"
# Levels of name comparison, best first, and the methods they stand for.
NAME_LEVELS = ["Exacta", "Coincide después de normalización", "Coincidencia mediante equivalencia institucional", "Posible coincidencia (alta confianza)", "Requiere revisión"]
NO_NAME = "Sin coincidencia"
METHODS = ["Exacta", "Normalización", "Abreviatura / equivalencia institucional", "Coincidencia aproximada (fuzzy)", "Revisión manual"]
NO_METHOD = "No aplica"
# What results of a comparison by ID say.
SAME, MOVED, AMBIGUOUS, NOT_FOUND = "Misma posición", "Diferente posición", "Coincidencia ambigua", "Puesto no encontrado"
UNVERIFIABLE, OTHER_BOSS, AMBIGUOUS_BOSS, BOSS_AGREES = "No verificable", "Jefe inmediato diferente", "Jefe ambiguo", "Coincide"
NO_BOSS, CHECK_ID, UNASSIGNED = "Sin referencia en Excel", "Revisar ID de Excel", "Sin referencia asignada"
NO_BOSS_ROW = "[ID de jefe no resoluble:"
