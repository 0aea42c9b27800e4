"""Command line: load CSV inputs, write reports, export the additive facts.

    python -m promolift load   <csv folder> <table folder>
    python -m promolift report <table folder> <report folder> scorecard_by_type [name ...]
    python -m promolift export <table folder> <csv folder>

Reports are written whole, as CSV with a header, one folder each. Settings are
options named like those of ``LiftConfig``, e.g. ``--window-start 2011-11-01
--drift-rate 0.05 --spend-columns MarkDown1,MarkDown2``. The session is the one
the launcher configures; without a launcher it is local.

A load is refused when more than ``--most-rejected`` (a share, 0 by default) of a
table's lines do not fit its columns, and leaves the tables as they were.
"""

from __future__ import annotations

import argparse
import dataclasses
import sys
from collections.abc import Callable
from datetime import date

from pyspark.sql import SparkSession

from promolift.config import LiftConfig
from promolift.plans.model import LiftModel, Tables
from promolift.plans.registry import FRAMES, REPORTS, report
from promolift.sources import files


def _names(text: str) -> tuple[str, ...]:
    return tuple(text.split(","))


def _bands(text: str) -> tuple[tuple[int, str], ...]:
    """150000:Large,70000:Medium"""
    pairs = (band.split(":") for band in text.split(","))
    return tuple((int(size), name) for size, name in pairs)


def _reader(default) -> Callable:
    if isinstance(default, date):
        return date.fromisoformat
    if isinstance(default, tuple):
        return _bands if isinstance(default[0], tuple) else _names
    return type(default)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="promolift", description=__doc__, formatter_class=argparse.RawTextHelpFormatter)
    out.add_argument("command", choices=("load", "report", "export"))
    out.add_argument("source")
    out.add_argument("target")
    out.add_argument("names", nargs="*", choices=[[], *FRAMES, *REPORTS], metavar="name")
    out.add_argument("--most-rejected", type=float, default=0.0)
    for field in dataclasses.fields(LiftConfig):
        out.add_argument(f"--{field.name.replace('_', '-')}", type=_reader(field.default), default=field.default)
    return out


def main(arguments: list[str]) -> int:
    chosen = parser().parse_args(arguments)
    config = LiftConfig(**{field.name: getattr(chosen, field.name) for field in dataclasses.fields(LiftConfig)})
    spark = SparkSession.builder.appName(f"promolift-{chosen.command}").getOrCreate()
    if chosen.command == "load":
        loaded = files.load_inputs(spark, chosen.source, chosen.target, config, most_rejected=chosen.most_rejected)
        for row in loaded.collect():
            print(row.table_name, row.rows, row.rejected)
        return 0
    model = LiftModel(Tables(**files.read_tables(spark, chosen.source)), config).with_stored_pairs()
    if chosen.command == "export":
        files.export_csv(model.exports(), chosen.target)
    else:
        files.export_csv({name: report(model, name) for name in chosen.names}, chosen.target)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
