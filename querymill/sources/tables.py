"""Reading and writing the engine's tables."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.functions import text
from querymill.operators import corpus, pairs

QUERY_SCHEMA = "qid string, original_query string, normalized_query string"
PAIR_SCHEMA = "prefix string, candidate string, label int, source string"


def read_queries(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """The query log, Parquet or JSON lines by suffix, required columns only; the first ``limit`` by qid if given."""
    raw = spark.read.schema(QUERY_SCHEMA).json(path) if path.rstrip("/").endswith((".json", ".jsonl")) else spark.read.parquet(path)
    rows = corpus.required_columns(raw)
    return rows if limit is None else rows.orderBy(*corpus.REQUIRED).limit(limit)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAIR_SCHEMA).json(path)


def write_pairs(rows: DataFrame, path: str, force: bool = False) -> None:
    """One JSON object a line."""
    rows.write.mode("overwrite" if force else "errorifexists").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report of one row as JSON."""
    report.coalesce(1).write.mode("overwrite").json(path)


def _rename(spark: SparkSession, source: str, target: str) -> None:
    jvm = spark._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    system = b.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(b):
        system.delete(b, True)
    if not system.rename(a, b):
        raise OSError(f"{source} could not be moved to {target}")


def sanitize_pairs(spark: SparkSession, source: str, target: str, report: str | None = None) -> dict:
    """Write the pairs without control characters, read them again to make sure, then put them in place."""
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("source and target must differ")
    rows = read_pairs(spark, source)
    counts = pairs.sanitize_counts(rows).first().asDict()
    staging = f"{target.rstrip('/')}.staging"
    pairs.sanitize(rows).write.mode("overwrite").json(staging)
    again = read_pairs(spark, staging)
    dirty = text.has_control(F.col("prefix")) | text.has_control(F.col("candidate"))
    found = again.agg(F.count(F.lit(1)).alias("n"), F.count_if(dirty).alias("dirty")).first()
    if found.dirty or found.n != counts["written"] or not found.n:
        raise ValueError(f"{found.n} rows written, {found.dirty} of them with control characters; {counts['written']} expected")
    _rename(spark, staging, target)
    if report:
        write_report(spark.createDataFrame([tuple(counts.values())], list(counts)), report)
    return counts


def read_config(path: str) -> dict:
    """Settings from a JSON or YAML file."""
    content = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(content)
    try:
        import yaml
    except ImportError as missing:
        raise ValueError("YAML settings need the yaml package; use JSON") from missing
    return yaml.safe_load(content) or {}


# The registry used where none is given.
BUILT_IN_REGISTRY = (
    {"domain": "wikipedia.org", "organization": "Wikimedia Foundation", "category": "Encyclopedia & Reference", "verified_since": "2024-01-15", "allow_subdomains": True},
    {"domain": "github.com", "organization": "GitHub / Microsoft", "category": "Software Development & Hosting", "verified_since": "2024-01-15", "allow_subdomains": True},
    {"domain": "python.org", "organization": "Python Software Foundation", "category": "Open Source Software", "verified_since": "2024-02-01", "allow_subdomains": True},
    {"domain": "google.com", "organization": "Google LLC", "category": "Search & Cloud Services", "verified_since": "2024-01-01", "allow_subdomains": True},
    {"domain": "fastapi.tiangolo.com", "organization": "FastAPI Project", "category": "Software Documentation", "verified_since": "2024-03-01", "allow_subdomains": False},
)


def read_registry(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """A host registry for ``suffix_lookup``; entries without a domain are dropped, defaults filled in; the built-in one if none is left."""
    entries = [e for e in entries if (e.get("domain") or "").strip()] or BUILT_IN_REGISTRY
    rows = [
        (e["domain"].strip().lower(), e.get("organization") or "Verified Organization", e.get("category") or "General", e.get("verified_since"), bool(e.get("allow_subdomains", True)), i)
        for i, e in enumerate(entries)
    ]
    return spark.createDataFrame(rows, "domain string, organization string, category string, verified_since string, allow_subdomains boolean, ordinal int")


