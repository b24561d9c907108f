"""The command line: python -m wideframe.cli COMMAND TABLE ..."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.render import ndjson, table_lines
from .operators.layout import Options
from .operators.stats import with_units
from .operators.table import WideTable, column_names
from .session import session
from .sources import files
from .sources.csv_import import Dialect, import_csv
from .sources.json_import import column_list, import_json, is_json
from .sources.sink import write_table
from .types import TableError


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="wideframe")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("schema", "meta", "pages", "cat", "head", "count", "footer", "column-size", "dictionary", "buckets"):
        c = sub.add_parser(name)
        c.add_argument("table")
        c.add_argument("--json", action="store_true")
        if name in ("pages", "cat", "head", "column-size"):
            c.add_argument("-c", "--columns")
        if name in ("cat", "head"):
            c.add_argument("-n", "--num", type=int, default=10 if name == "head" else None)
            c.add_argument("--where")
        if name == "dictionary":
            c.add_argument("-c", "--column", required=True)
    for name in ("convert", "convert-csv"):
        c = sub.add_parser(name)
        c.add_argument("inputs", nargs="+" if name == "convert-csv" else 1)
        c.add_argument("-o", "--output", "--out", required=True)
        c.add_argument("--stats")
        c.add_argument("--overwrite", action="store_true")
        if name == "convert":
            c.add_argument("-c", "--column", action="append", default=[])
        else:
            c.add_argument("--require", action="append", default=[])
            c.add_argument("--delimiter", default=",")
            c.add_argument("--escape")
            c.add_argument("--quote", default='"')
            c.add_argument("--header")
            c.add_argument("--no-header", action="store_true")
            c.add_argument("--skip-lines", type=int, default=0)
    return p


def _lines(df: DataFrame) -> Iterator[str]:
    return (f"{r[0]}\n" for r in ndjson(df).toLocalIterator())


def _report(df: DataFrame, as_json: bool, rows: int | None = None) -> Iterator[str]:
    return _lines(df) if as_json else table_lines(df, rows)


def lines(spark: SparkSession, argv: list[str]) -> Iterator[str]:
    """What the command prints, in portions."""
    a = parser().parse_args(argv)
    if a.command in ("convert", "convert-csv"):
        yield _convert(spark, a)
        return
    t = WideTable.open(spark, a.table)
    if a.command in ("cat", "head"):
        yield from _report(t.cat(a.num, column_names(a.columns), a.where), a.json, a.num)
    elif a.command == "count":
        n = t.count()
        yield (json.dumps({"rows": n}, separators=(",", ":")) if a.json else str(n)) + "\n"
    elif a.command == "meta":
        own = t.stats().drop("rows")
        if not a.json:
            own = with_units(own, t.schema_)
        yield from _report(t.meta(), a.json)
        yield from _report(t.row_groups().join(own, "row_group", "left").orderBy("row_group", "column"), a.json)
    elif a.command == "column-size":
        sizes = t.column_sizes(column_names(a.columns))
        yield from _report(sizes.orderBy("column"), a.json)
        total = sizes.agg(F.sum("bytes").alias("total_bytes"), F.bool_or("approximate").alias("approximate"))
        yield from _report(total, a.json)
    elif a.command == "buckets":
        yield from _report(t.buckets().orderBy("row_group", "bucket"), a.json)
        yield from _report(t.stored().orderBy("row_group"), a.json)
    else:
        made = {
            "schema": lambda: t.schema_report().orderBy("position"),
            "pages": lambda: t.pages(column_names(a.columns)).orderBy("row_group", "column"),
            "footer": t.footer,
            "dictionary": lambda: t.dictionary(a.column).orderBy("row_group", "nth"),
        }[a.command]()
        yield from _report(made, a.json)


def run(spark: SparkSession, argv: list[str]) -> str:
    """All that the command prints."""
    return "".join(lines(spark, argv))


def _convert(spark: SparkSession, a: argparse.Namespace) -> str:
    files.refuse_existing(spark, a.output, a.overwrite)
    if a.command == "convert" and is_json(a.inputs[0]):
        names = column_list(a.column) if a.column else None
        df = import_json(spark, a.inputs[0], names)
    elif a.command == "convert":
        if a.column:
            raise TableError("--column is for JSON inputs")
        df = import_csv(spark, a.inputs, legacy=True)
    else:
        dialect = Dialect(a.delimiter, a.quote, a.escape, a.no_header, a.header, a.skip_lines)
        df = import_csv(spark, a.inputs, dialect, a.require)
    stats = tuple(column_names(a.stats) or ())
    write_table(df, a.output, Options(stats_columns=stats), a.overwrite)
    n = WideTable.open(spark, a.output).count()
    return f"wrote {a.output} ({n} rows, {len(df.columns)} columns)\n"


def main() -> int:
    try:
        sys.stdout.writelines(lines(session(), sys.argv[1:]))
    except TableError as e:
        sys.stderr.write(f"error: {e}\n")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
