"""What a run read and wrote, told to a file and to the console, from counts that the reading passes take along."""

from __future__ import annotations

import logging
import os

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cotejo.plans.saved import saved

#: The log's file, and how its lines look.
FILE = os.path.join("logs", "proceso.log")
LINE, TIME = "%(asctime)s | %(levelname)-8s | %(name)s | %(message)s", "%Y-%m-%d %H:%M:%S"


def logger(name: str = "cotejo", path: str | None = None) -> logging.Logger:
    """The logger of that name; with a path it writes there too, everything, while the console gets what is told at level INFO.  Handlers are added once."""
    log = logging.getLogger(name)
    log.setLevel(logging.DEBUG)
    form = logging.Formatter(LINE, TIME)
    if not any(type(h) is logging.StreamHandler for h in log.handlers):
        console = logging.StreamHandler()
        console.setLevel(logging.INFO)
        console.setFormatter(form)
        log.addHandler(console)
    if path and not any(isinstance(h, logging.FileHandler) and h.baseFilename == os.path.abspath(path) for h in log.handlers):
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        to_file = logging.FileHandler(path, encoding="utf-8")
        to_file.setLevel(logging.DEBUG)
        to_file.setFormatter(form)
        log.addHandler(to_file)
    return log


def counted(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """df, saved, and counts of it that the pass which saves it takes along; rows counts all.

    The counts are an observation, so nothing is read a second time.
    """
    seen = Observation()
    kept = saved(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in counts.items()]))
    return kept, dict(seen.get)


def extracted(df: DataFrame, source: str, path: str, log: logging.Logger) -> tuple[DataFrame, dict[str, int]]:
    """Positions of a source, saved, with their counts of rows and errors told to the log."""
    error = F.col("error").isNotNull() if "error" in df.columns else F.lit(False)
    kept, told = counted(df, errors=F.count_if(error))
    log.info("%s '%s': %d registro(s) extraído(s).", source, os.path.basename(path.rstrip("/")), told["rows"] - told["errors"])
    if told["errors"]:
        log.error("%s '%s': %d error(es) de extracción.", source, os.path.basename(path.rstrip("/")), told["errors"])
    return kept, told
