"""Pipeline settings, resolved on the driver."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PipelineConfig:
    """What one version of the offline pipeline does, and its operating parameters."""

    process_office_files: bool
    extract_with_model: bool
    crawl: bool
    chunk_chars: int = 15000
    crawl_limit: int = 1000
    write_batch: int = 5000
    top_k: int = 5


# The four versions and what each switches on.
VERSIONS = {
    1: PipelineConfig(process_office_files=False, extract_with_model=False, crawl=False),
    2: PipelineConfig(process_office_files=False, extract_with_model=True, crawl=False),
    3: PipelineConfig(process_office_files=True, extract_with_model=True, crawl=True),
    4: PipelineConfig(process_office_files=True, extract_with_model=True, crawl=True),
}


def config_for(version: int | str) -> PipelineConfig:
    """Settings of a version; an unknown number gets those of version 1, what is no integer raises ValueError.

    Whether pages are crawled depends on the number alone: every version above 2 crawls.
    """
    number = int(version)
    base = VERSIONS.get(number, VERSIONS[1])
    return base if base.crawl == (number > 2) else PipelineConfig(base.process_office_files, base.extract_with_model, number > 2)


def crawl_roots(version: int | str, roots: list[str]) -> list[str]:
    """The roots that a version crawls, of those given in order: none up to version 2, all in version 4, else the first."""
    number = int(version)
    return [] if number <= 2 else list(roots) if number == 4 else list(roots[:1])
