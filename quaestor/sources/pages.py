"""Page scans: a pluggable fetcher over a table of addresses, and crawled pages per root."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.functions.text import between_markers, page_header, safe_name
from quaestor.operators.relational import last_per_key, limit_per_group


class Fetcher(Protocol):
    """Gets the text and links of one address; raises on failure.  Made anew on each worker; a timeout is bound to it with ``functools.partial``."""

    def fetch(self, url: str) -> tuple[str, list[str]]: ...


def fetch_pages(urls: DataFrame, make: Callable[[], Fetcher], delay: float = 0.0) -> DataFrame:
    """``(url, text, links, error)``: one row per address; failures, missing texts included, have an error and no text.

    After each page that was got, a task waits ``delay`` seconds; how many tasks there are is up to the
    partitions of ``urls``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetcher = make()
        for batch in batches:
            rows = []
            for url in batch["url"]:
                try:
                    text, links = fetcher.fetch(url)
                    if text is None:
                        raise ValueError("no text")
                    rows.append((url, text, list(links or []), None))
                    if delay:
                        time.sleep(delay)
                except Exception as e:  # one address fails, the scan goes on
                    rows.append((url, None, [], str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["url", "text", "links", "error"])

    return urls.select("url").mapInPandas(run, "url string, text string, links array<string>, error string")


def crawled_pages(pages: DataFrame, roots: list[str] | None = None, limit: int = 1000) -> DataFrame:
    """At most ``limit`` pages of each root, the first by page id; missing texts become empty; pages without root or address are left out."""
    known = pages.where("crawl_root is not null and url is not null")
    if roots is not None:
        known = known.where(F.col("crawl_root").isin(roots))
    return limit_per_group(known, "crawl_root", ["page_id"], limit).withColumn("text", F.coalesce("text", F.lit("")))


def text_files(pages: DataFrame, head: str, foot: str, order: str) -> DataFrame:
    """``(file, text)``: trimmed pages with an address header, named after their address; of equal names the last page wins."""
    body = between_markers(F.coalesce("text", F.lit("")), head, foot)
    named = pages.where("url is not null").select(F.concat(safe_name(F.col("url")), F.lit(".txt")).alias("file"), F.col(order).alias("_o"), page_header(F.col("url"), body).alias("text"))
    return last_per_key(named, ["file"], ["_o"]).drop("_o")
