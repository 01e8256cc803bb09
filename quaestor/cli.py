"""Asking questions from a terminal, and logging."""

from __future__ import annotations

import argparse
import logging
import sys
from collections.abc import Iterable, Iterator
from logging.handlers import RotatingFileHandler
from pathlib import Path


def questions(lines: Iterable[str]) -> Iterator[str | None]:
    """Stripped questions up to a line ``q`` or ``Q``; None stands for an empty one."""
    for line in lines:
        line = line.strip()
        if line in ("q", "Q"):
            return
        yield line or None


def log_level(name: str | None) -> int:
    """A level by its name in any case; INFO for none and for unknown ones."""
    return logging.getLevelNamesMapping().get((name or "").upper(), logging.INFO)


def setup_logging(file: str | None = None, level: str | None = None) -> logging.Logger:
    """The library's logger, writing to the console and, if named, to a file that is rotated at 5 MB and kept five times."""
    log = logging.getLogger("quaestor")
    log.setLevel(log_level(level))
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if file:
        Path(file).parent.mkdir(parents=True, exist_ok=True)
        handlers.append(RotatingFileHandler(file, maxBytes=5_000_000, backupCount=5, encoding="utf-8"))
    for old in list(log.handlers):
        log.removeHandler(old)
    for h in handlers:
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
        log.addHandler(h)
    return log


def main(arguments: list[str] | None = None) -> int:
    """Answer each line of the standard input from an index; sources are not shown."""
    parser = argparse.ArgumentParser(prog="quaestor", description=main.__doc__)
    parser.add_argument("index", help="path of the vector index")
    parser.add_argument("--top-k", type=int, default=5)
    parser.add_argument("--log", help="log file")
    options = parser.parse_args(arguments)
    log = setup_logging(options.log)

    from pyspark.sql import SparkSession

    from quaestor.plans.pipeline import answer
    from quaestor.plans.ship import ship

    spark = SparkSession.builder.appName("quaestor").getOrCreate()
    ship(spark)
    for question in questions(sys.stdin):
        if question is None:
            log.error("empty question")
            continue
        asked = spark.createDataFrame([(1, question, None, None)], "query_id long, query string, field_of_study string, semester string")
        for r in answer(spark, asked, options.index, "Nothing was found.", "No answer could be made.", options.top_k).collect():
            print(r["answer"], flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())
