"""Extensions by name (P1 to P4): rules over fetches and pages, scans of bodies, and writers of reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Where it applies, and the warning (tag, msg) and info that it gives, or null."""

    name: str
    applies: Column
    warning: Column | None = None
    info: Column | None = None


def checked(rows: DataFrame, rules: Sequence[Rule], enabled: Sequence[str] | None = None) -> DataFrame:
    """rows with warnings and info of the enabled rules, each once, in one pass."""
    on = [r for r in rules if enabled is None or r.name in enabled]
    told = lambda r, value: F.when(r.applies, value)
    warned = F.array(F.lit(None).cast("struct<tag:string,msg:string>"), *[told(r, r.warning) for r in on if r.warning is not None])
    infos = F.array(F.lit(None).cast("string"), *[told(r, r.info) for r in on if r.info is not None])
    return rows.withColumns({"warnings": F.array_distinct(F.array_compact(warned)), "info": F.array_distinct(F.array_compact(infos))})


@dataclass(frozen=True)
class Scan:
    """Where it applies, and how bodies (url, body) become links (url, raw_url)."""

    name: str
    applies: Column
    links: Callable[[DataFrame], DataFrame]


def scanned(bodies: DataFrame, scans: Sequence[Scan], enabled: Sequence[str] | None = None) -> DataFrame:
    """url, scan and raw_url; a body goes to the first enabled scan that applies."""
    on = [s for s in scans if enabled is None or s.name in enabled]
    first = F.coalesce(*[F.when(s.applies, s.name) for s in on], F.lit(None).cast("string"))
    known, out = bodies.withColumn("scan", first), None
    for s in on:
        found = s.links(known.where(F.col("scan") == s.name)).select("url", F.lit(s.name).alias("scan"), "raw_url")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else bodies.select("url", F.lit("").alias("scan"), F.lit("").alias("raw_url")).limit(0)


#: Writers of reports by name, each from records to lines of text or rows.
REPORTS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def report(name: str) -> Callable[[Callable[[DataFrame], DataFrame]], Callable[[DataFrame], DataFrame]]:
    """Registers a writer under a name."""

    def put(writer: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        REPORTS[name] = writer
        return writer

    return put


def written_as(name: str, records: DataFrame) -> DataFrame:
    if name not in REPORTS:
        raise ValueError(f"no report is called {name}; there are {', '.join(sorted(REPORTS))}")
    return REPORTS[name](records)
