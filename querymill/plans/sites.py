"""The check of addresses as one run: analysis, cache, registry and threat feed, without a verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querymill.operators import requests, urls
from querymill.runtime import written


def check_sites(df: DataFrame, url: str, request: str, seconds: str, registry: DataFrame, feed: DataFrame, ttl: float = 300.0) -> DataFrame:
    """What is known of each requested address: (request, url, domain, is_valid, cached, organization, known_threat, threat_type, provider_hits, unavailable_checks).

    Addresses of one scheme, host and port share a cache entry for ``ttl`` seconds; a cached answer
    shows the address that filled the entry.  Invalid addresses are shown as they came, aren't cached
    and have the domain ``unknown`` if no host can be told.  Hosts are looked up once each.
    """
    facts = urls.analyze_urls(df.select(F.col(request).alias("request"), F.col(seconds).alias("seconds"), F.col(url).alias("raw")), "raw")
    facts = written(facts.select("request", "seconds", "raw", "normalized_url", "scheme", "hostname", "port", F.col("validation_error").isNull().alias("is_valid")), "sites")
    key = F.concat("scheme", F.lit("://"), "hostname", F.lit(":"), F.coalesce(F.col("port").cast("string"), F.lit("")))
    flagged = written(requests.ttl_cache(facts.where("is_valid").withColumn("key", key), "key", "seconds", "request", ttl), "cached")
    filled = flagged.where("not cached").select(F.col("request").alias("first_tie"), F.col("normalized_url").alias("url"))
    hosts = urls.suffix_lookup(flagged.select("hostname").distinct(), "hostname", registry)
    known = urls.threat_lookup(hosts, "hostname", feed).select("hostname", "organization", "known_threat", "threat_type", "provider_hits", "unavailable_checks")
    valid = flagged.join(filled, "first_tie").join(known, "hostname").select(
        "request", "url", F.col("hostname").alias("domain"), "is_valid", "cached", "organization", "known_threat", "threat_type", "provider_hits", "unavailable_checks"
    )
    none = F.array().cast("array<string>")
    domain = F.coalesce(F.nullif(F.col("hostname"), F.lit("")), F.lit("unknown"))
    invalid = facts.where("not is_valid").select(
        "request", F.col("raw").alias("url"), domain.alias("domain"), "is_valid", F.lit(False).alias("cached"), F.lit(None).cast("string").alias("organization"),
        F.lit(False).alias("known_threat"), F.lit(None).cast("string").alias("threat_type"), none.alias("provider_hits"), none.alias("unavailable_checks"),
    )
    return valid.unionByName(invalid).withColumnRenamed("request", request)


def site_health(checks: DataFrame, registry: DataFrame) -> DataFrame:
    """One row: registry entries, and of the checks all, cached, invalid, matched and threatened ones, and the cache entries filled."""
    entries = registry.agg(F.count_distinct(F.lower(F.trim("domain"))).alias("registry_entries"))
    return entries.join(
        checks.agg(
            F.count(F.lit(1)).alias("checks"), F.count_if("cached").alias("cached"), F.count_if(~F.col("is_valid")).alias("invalid"),
            F.count_if(F.col("organization").isNotNull()).alias("matched"), F.count_if("known_threat").alias("threats"),
            F.count_if(F.col("is_valid") & ~F.col("cached")).alias("filled"),
        ),
        how="inner", on=F.lit(True),
    )  # one row each
