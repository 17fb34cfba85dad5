"""URL analysis: canonical form, host, registrable domain and structural facts, and host lookups.

Plain ASCII addresses, nearly all of them, are taken apart by JVM expressions; only addresses with
credentials, IP literals, brackets or non-ASCII hosts go through an Arrow function.
"""

from __future__ import annotations

import ipaddress
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Public suffixes of two labels.
TWO_PART_SUFFIXES = (
    "co.uk", "org.uk", "gov.uk", "ac.uk", "com.au", "net.au", "org.au", "edu.au", "co.nz", "net.nz", "org.nz",
    "co.jp", "ne.jp", "or.jp", "com.br", "org.br", "co.in", "net.in", "org.in", "gen.in", "com.sg", "edu.sg",
)
# Names that stand out in a subdomain.
SUBDOMAIN_TOKENS = (
    "paypal", "apple", "google", "microsoft", "amazon", "netflix", "login", "verify", "secure", "account",
    "banking", "update", "signin", "wallet", "crypto", "security", "support",
)
LOCAL_NAMES = ("localhost", "ip6-localhost", "ip6-loopback")
LOCAL_SUFFIXES = (".local", ".localhost", ".internal", ".lan", ".test", ".example", ".invalid")

FIELDS = (
    "normalized_url string, scheme string, hostname string, apex_domain string, subdomain string, subdomain_depth int, port int, is_ip boolean, "
    "is_private_or_local boolean, is_punycode_or_idn boolean, has_userinfo boolean, suspicious_tokens array<string>, validation_error string"
)
_NAMES = [f.split()[0] for f in FIELDS.split(", ")]

_PLAIN = r"^(?:([hH][tT][tT][pP][sS]?)://)?([A-Za-z0-9._-]*[A-Za-z_-][A-Za-z0-9._-]*)(?::([0-9]{1,9}))?(/[^\s?#]*)?(?:[?#][^\s]*)?$"


NO_ADDRESS, NO_HOST = "no address given", "no host name"


def _plain_parts(url: Column) -> Column:
    """Scheme, host, port and path of a plain address, by one match; null for any other."""
    text = F.trim(url)
    parts = F.split(F.regexp_replace(text, _PLAIN, "$1\u0001$2\u0001$3\u0001$4"), "\u0001")
    bare = ~F.contains(text, F.lit("://")) | text.rlike(r"^[hH][tT][tT][pP][sS]?://")
    return F.when(~text.rlike(r"[^\x21-\x7e]") & bare & (F.size(parts) == 4), parts)


def apex_parts(labels: Column) -> Column:
    """How many of a host's labels make up its registrable domain."""
    two = F.array_join(F.slice(labels, -2, 2), ".")
    return F.when(F.size(labels) < 2, F.size(labels)).when((F.size(labels) >= 3) & two.isin(*TWO_PART_SUFFIXES), 3).otherwise(2)


def _plain_columns(df: DataFrame, parts: str) -> DataFrame:
    part = lambda n: F.col(parts)[n]
    rows = df.withColumns({
        "scheme": F.when(part(0) == "", "https").otherwise(F.lower(part(0))),
        "hostname": F.lower(F.regexp_replace(part(1), r"\.+$", "")),
        "port": F.when(part(2) != "", part(2).cast("int")),
        "__path": F.when(part(3) == "", "/").otherwise(part(3)),
    })
    host = F.col("hostname")
    local = host.isin(*LOCAL_NAMES)
    for suffix in LOCAL_SUFFIXES:
        local = local | host.endswith(suffix)
    rows = rows.withColumns({
        "is_private_or_local": local, "is_punycode_or_idn": host.contains("xn--"), "__labels": F.split(host, r"\."),
        "is_ip": F.lit(False), "has_userinfo": F.lit(False),
    })
    problem = F.when(host == "", NO_HOST).when(~host.contains(".") & ~F.col("is_private_or_local"), _no_dot(host))
    rows = rows.withColumn("validation_error", problem)
    ok, labels = F.col("validation_error").isNull(), F.col("__labels")
    n = apex_parts(labels)
    rows = rows.withColumns({
        "apex_domain": F.when(ok, F.array_join(F.slice(labels, -n, n), ".")).otherwise(host),
        "subdomain": F.when(ok & (F.size(labels) > n), F.array_join(F.slice(labels, F.lit(1), F.greatest(F.lit(1), F.size(labels) - n)), ".")).otherwise(""),
    })
    names = F.array(*map(F.lit, SUBDOMAIN_TOKENS))
    port = F.when(F.col("port").isNotNull() & ~F.col("port").isin(0, 80, 443), F.concat(F.lit(":"), F.col("port").cast("string"))).otherwise("")
    return rows.withColumns({
        "subdomain_depth": F.when(F.col("subdomain") == "", 0).otherwise(F.size(F.split("subdomain", r"\."))),
        "suspicious_tokens": F.array_sort(F.filter(names, lambda t: F.contains(F.col("subdomain"), t) & ~F.contains(F.col("apex_domain"), t))),
        "normalized_url": F.when(ok, F.concat("scheme", F.lit("://"), "hostname", port, "__path")).otherwise(""),
        "is_private_or_local": ok & F.col("is_private_or_local"),
    }).drop("__path", "__labels")


def _no_dot(host):
    head, tail = "host name ", " has no dot and is no local name"
    return F.concat(F.lit(head), host, F.lit(tail)) if isinstance(host, Column) else f"{head}{host}{tail}"


def _invalid(error: str, **known) -> dict:
    empty = dict(normalized_url="", scheme="", hostname="", apex_domain="", subdomain="", subdomain_depth=0, port=None, is_ip=False)
    return empty | dict(is_private_or_local=False, is_punycode_or_idn=False, has_userinfo=False, suspicious_tokens=[], validation_error=error) | known


def _host_and_port(authority: str) -> tuple[str, int | None]:
    """An IPv6 literal has brackets; one colon divides host and port; more colons belong to the host."""
    if authority.startswith("[") and "]" in authority:
        host, _, rest = authority[1:].partition("]")
        number = rest[1:] if rest.startswith(":") else ""
    elif authority.count(":") == 1:
        host, number = authority.split(":")
    else:
        return authority, None
    try:
        return host, int(number)
    except ValueError:
        return host, None


def analyze(raw: str | None) -> dict:
    """The facts about one address; the JVM expressions give the same for plain ones."""
    text = (raw or "").strip()
    if not text:
        return _invalid(NO_ADDRESS)
    try:
        parts = urlsplit(text if "://" in text else f"https://{text}")
    except ValueError as problem:
        return _invalid(f"not a well-formed address: {problem}")
    scheme = parts.scheme.lower() or "https"
    if scheme not in ("http", "https"):
        return _invalid(f"scheme {scheme} is neither http nor https", scheme=scheme)
    userinfo = bool(parts.username or parts.password)
    host, port = _host_and_port(parts.netloc.rpartition("@")[2])
    host = host.rstrip(".").lower()
    known = dict(scheme=scheme, port=port, has_userinfo=userinfo)
    if not host:
        return _invalid(NO_HOST, **known)
    local = host in LOCAL_NAMES or host.endswith(LOCAL_SUFFIXES)
    try:
        address = ipaddress.ip_address(host)
        local = any((address.is_private, address.is_loopback, address.is_reserved, address.is_link_local, address.is_unspecified))
    except ValueError:
        address = None
    idn = not host.isascii()
    try:
        encoded = host.encode("idna").decode("ascii")
        idn = idn or "xn--" in encoded
        host = encoded if idn else host
    except UnicodeError:
        pass
    if address is None and not local and "." not in host:
        return _invalid(_no_dot(host), hostname=host, apex_domain=host, is_punycode_or_idn=idn, **known)
    labels = [host] if address else host.split(".")
    kept = 3 if len(labels) >= 3 and ".".join(labels[-2:]) in TWO_PART_SUFFIXES else 2
    apex, sub = ".".join(labels[-kept:]), labels[:-kept]
    below = ".".join(sub)
    shown = f":{port}" if port and port not in (80, 443) else ""
    return known | dict(
        normalized_url=f"{scheme}://{host}{shown}{parts.path or '/'}", hostname=host, apex_domain=apex, subdomain=below, subdomain_depth=len(sub),
        is_ip=address is not None, is_private_or_local=local, is_punycode_or_idn=idn,
        suspicious_tokens=sorted(t for t in SUBDOMAIN_TOKENS if t in below and t not in apex), validation_error=None,
    )


def analyze_urls(df: DataFrame, url: str) -> DataFrame:
    """``df`` with the facts about each address; malformed ones have a validation_error and empty facts.

    The input is read once: plain addresses pass the Arrow function as nulls.
    """

    @F.pandas_udf(FIELDS)
    def odd_facts(addresses: pd.Series) -> pd.DataFrame:
        nothing = dict.fromkeys(_NAMES)
        facts = pd.DataFrame([nothing if u is None else analyze(u) for u in addresses], columns=_NAMES)
        facts["port"], facts["subdomain_depth"] = facts["port"].astype("Int32"), facts["subdomain_depth"].astype("Int32")
        return facts

    kept = [F.col(f"`{c}`") for c in df.columns]
    marked = df.withColumn("__parts", _plain_parts(F.col(url)))
    odd = F.when(F.col("__parts").isNull(), F.coalesce(F.col(url), F.lit("")))
    rows = _plain_columns(marked.withColumn("__odd", odd_facts(odd)), "__parts")
    facts = [F.when(F.col("__parts").isNotNull(), F.col(c)).otherwise(F.col(f"__odd.{c}")).alias(c) for c in _NAMES]
    return rows.select(*kept, *facts)


def suffix_lookup(df: DataFrame, host: str, registry: DataFrame) -> DataFrame:
    """``df`` left-joined with the registry entry of each host: the exact one, else the first parent that allows subdomains.

    ``registry`` has domain, allow_subdomains and ordinal, besides what it tells; later entries of
    one domain replace earlier ones.  Hosts are looked up once each, by an equi-join on their
    suffixes, so neither side needs to be small.
    """
    latest = Window.partitionBy("domain").orderBy(F.desc("ordinal"))
    entries = registry.withColumn("domain", F.lower(F.trim("domain"))).withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n")
    first = registry.withColumn("domain", F.lower(F.trim("domain"))).groupBy("domain").agg(F.min("ordinal").alias("__first"))
    entries = entries.join(first, "domain")
    hosts = df.select(F.col(host).alias("__host")).where("__host is not null").distinct()
    labels = F.split("__host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    matched = hosts.select("__host", F.explode(suffixes).alias("domain")).join(entries, "domain")
    matched = matched.where((F.col("domain") == F.col("__host")) | F.col("allow_subdomains"))
    best = Window.partitionBy("__host").orderBy(F.desc(F.col("domain") == F.col("__host")), "__first")
    chosen = matched.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n", "__first", "ordinal", "allow_subdomains")
    return df.join(chosen, df[host] == chosen["__host"], "left").drop("__host")


# Hosts that serve to test such lookups.
TEST_THREATS = {
    "testsafebrowsing.appspot.com": "MALWARE (Google SafeBrowsing Test)", "malware.wicar.org": "MALWARE (WICAR Test Site)",
    "phishing-test.badssl.com": "SOCIAL_ENGINEERING (Phishing Test)", "evil-phishing-test.com": "SOCIAL_ENGINEERING (Test Threat)",
    "malicious-domain.test": "MALWARE (Local Test Blocklist)", "phishing-brand-update.test": "SOCIAL_ENGINEERING (Brand Phishing)",
}
FEED = "provider string, key string, hit boolean, threat_type string, available boolean, ordinal int"


def sample_threats(spark: SparkSession) -> DataFrame:
    """The test hosts as a feed of the provider ``local_blocklist``."""
    return spark.createDataFrame([("local_blocklist", host, True, kind, True, 0) for host, kind in TEST_THREATS.items()], FEED)


def threat_lookup(df: DataFrame, host: str, feed: DataFrame) -> DataFrame:
    """``df`` with the providers that list each host, in their order, the first one's threat type, and those that gave no answer.

    ``feed`` has provider, key, hit, threat_type, available and ordinal; a provider that is not
    available for a host is among its unavailable_checks, whatever the others say.
    """
    place = F.struct("ordinal", "provider", "threat_type")
    pick = lambda test: F.sort_array(F.collect_list(F.when(test, place)))
    listed = feed.groupBy(F.lower("key").alias("__key")).agg(pick(F.col("hit") & F.col("available")).alias("__hits"), pick(~F.col("available")).alias("__none"))
    joined = df.join(listed, F.lower(df[host]) == F.col("__key"), "left")
    none = F.array().cast("array<string>")
    return joined.withColumns({
        "provider_hits": F.coalesce(F.col("__hits.provider"), none), "threat_type": F.get("__hits", 0)["threat_type"],
        "known_threat": F.coalesce(F.size("__hits") > 0, F.lit(False)), "unavailable_checks": F.coalesce(F.col("__none.provider"), none),
    }).drop("__key", "__hits", "__none")


def scan_verdict(malicious: Column, suspicious: Column) -> Column:
    """The hit a multi-engine scanner's counts amount to, or null: any malicious or several suspicious findings."""
    m, s = F.coalesce(malicious, F.lit(0)), F.coalesce(suspicious, F.lit(0))
    return F.when((m > 0) | (s > 1), F.concat(F.lit("MALICIOUS_DETECTIONS_"), m.cast("string")))
