"""python -m cotejo: compares a spreadsheet, a chart and a document, and writes a report."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from cotejo.plans import files, report, runlog
from cotejo.plans.saved import run_folder


def main(arguments: list[str] | None = None) -> int:
    """0, or 1 if a source couldn't be read."""
    parser = argparse.ArgumentParser(prog="cotejo", description=__doc__)
    parser.add_argument("--excel", required=True, help="workbook, or a folder of workbooks")
    parser.add_argument("--organigrama", required=True, help="folder of the chart's tables: pages, rects, lines, segments")
    parser.add_argument("--word", help="document (.docx), or a folder of a converted document's tables; needed in the mode completo")
    parser.add_argument("--modo", choices=["completo", "excel_organigrama"], default="completo")
    parser.add_argument("--salida", default="reporte_inconsistencias.xlsx")
    parser.add_argument("--hoja", help="the one sheet to read")
    parser.add_argument("--bitacora", default=runlog.FILE, help="the log's file")
    args = parser.parse_args(arguments)
    if args.modo == "completo" and not args.word:
        parser.error("--word is needed in the mode completo")
    log = runlog.logger(path=args.bitacora)
    spark = SparkSession.builder.appName("cotejo").getOrCreate()
    with_word = args.modo == "completo"
    with run_folder(spark):
        read = {"excel": ("Excel", args.excel, files.excel_positions(spark, args.excel, args.hoja)), "organigrama": ("Organigrama", args.organigrama, files.read_chart(spark, args.organigrama))}
        if with_word:
            read["word"] = ("Word", args.word, files.word_positions(spark, args.word))
        sources, failed = {}, 0
        for s, (name, path, df) in read.items():
            sources[s], told = runlog.extracted(df, name, path, log)
            if told["errors"]:
                failed += told["errors"]
                for r in sources[s].where("error IS NOT NULL").select("error").toLocalIterator():
                    log.error("%s: %s", name, r["error"])
        results, told = runlog.counted(files.compare(sources["excel"], sources.get("word"), sources["organigrama"]))
        report.write(results, sources, args.salida, with_word)
        log.info("Comparación finalizada: %d resultado(s) generado(s).", told["rows"])
        log.info("Reporte generado en: %s", args.salida)
        print(f"{told['rows']} results: {args.salida}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
