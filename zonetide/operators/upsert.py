"""One merge operator for all stored tables.

Parquet has no row update, so a table is a ledger of batches folded on read: one grouping
by key, with an aggregate per column. Everything folds map-side first, so a key that holds
most of the ledger still reaches its reducer as one row per task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.numbers import flag


@dataclass(frozen=True)
class MergePolicy:
    """How each column of a table takes a newer value.

    ``add`` sums, ``overwrite`` takes the last value even if null, ``keep`` takes the last
    value that is not null. ``defaults`` fill missing values of a batch before it is stored.
    """

    keys: tuple[str, ...]
    schema: T.StructType
    add: tuple[str, ...] = ()
    overwrite: tuple[str, ...] = ()
    keep: tuple[str, ...] = ()
    defaults: dict[str, str] = field(default_factory=dict)
    zero: tuple[str, ...] = ()
    flags: tuple[str, ...] = ()
    lower: tuple[str, ...] = ()
    text_keys: tuple[str, ...] = ()
    number_keys: tuple[str, ...] = ()


_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def _schema(columns: str) -> T.StructType:
    """Struct of ``name type, ...`` without needing a session, as ``fromDDL`` would."""
    pairs = [c.split() for c in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


_PROBE_ATTRIBUTES = _schema(
    "registrar_iana_id bigint, ns_provider string, ns_records_count bigint, ns_country string, "
    "mx_provider string, has_mx boolean, hosting_provider string, a_asn bigint, has_aaaa boolean, "
    "dnssec boolean, caa_present boolean, cert_issuer string, analytics_provider string, "
    "tag_managers string, marketing_stack string, cdn_provider string, http_server string, "
    "probe_status string, notes string"
)

POLICIES: dict[str, MergePolicy] = {
    "global_stats": MergePolicy(
        keys=("date",),
        schema=_schema("date string, domains_tracked_lifetime bigint, domains_tracked_24h bigint"),
        add=("domains_tracked_lifetime", "domains_tracked_24h"),
    ),
    "length_stats": MergePolicy(
        keys=("snap_date", "tld", "length"),
        schema=_schema(
            "snap_date string, tld string, length bigint, total_possible bigint, "
            "tracked_count bigint, unregistered_found bigint, unused_found bigint"
        ),
        add=("tracked_count", "unregistered_found", "unused_found"),
        overwrite=("total_possible",),
    ),
    "word_pos_stats": MergePolicy(
        keys=("snap_date", "tld", "pos", "length"),
        schema=_schema(
            "snap_date string, tld string, pos string, length bigint, "
            "tracked_count bigint, unregistered_found bigint, unused_found bigint"
        ),
        add=("tracked_count", "unregistered_found", "unused_found"),
    ),
    "tld_dim": MergePolicy(
        keys=("tld",),
        schema=_schema(
            "tld string, type string, registry string, jurisdiction string, in_czds boolean, "
            "launched_at string, ga_at string, status string, notes string"
        ),
        overwrite=("type", "in_czds", "status"),
        keep=("registry", "jurisdiction", "launched_at", "ga_at", "notes"),
        defaults={"status": "active"},
        flags=("in_czds",),
        text_keys=("tld", "type"),
    ),
    "registrar_dim": MergePolicy(
        keys=("iana_id",),
        schema=_schema(
            "iana_id bigint, name string, display_name string, jurisdiction string, "
            "accredited_at string, status string, rdap_base_url string, website string, notes string"
        ),
        overwrite=("name", "status"),
        keep=("display_name", "jurisdiction", "accredited_at", "rdap_base_url", "website", "notes"),
        defaults={"status": "accredited"},
        text_keys=("name",),
        number_keys=("iana_id",),
    ),
    "registrar_monthly_stats": MergePolicy(
        keys=("report_month", "iana_id", "tld"),
        schema=_schema(
            "report_month string, iana_id bigint, tld string, net_adds bigint, renewals bigint, "
            "transfers bigint, deletes bigint, domains_under_mgmt bigint, source_url string"
        ),
        overwrite=("net_adds", "renewals", "transfers", "deletes", "domains_under_mgmt"),
        keep=("source_url",),
        zero=("net_adds", "renewals", "transfers", "deletes", "domains_under_mgmt"),
        text_keys=("report_month", "tld"),
        number_keys=("iana_id",),
    ),
    "zone_diff_daily": MergePolicy(
        keys=("snap_date", "tld"),
        schema=_schema(
            "snap_date string, tld string, registered_total bigint, new_today bigint, "
            "dropped_today bigint, zone_size_bytes bigint, source string, notes string"
        ),
        overwrite=("registered_total", "new_today", "dropped_today", "source"),
        keep=("zone_size_bytes", "notes"),
        defaults={"source": "czds"},
        zero=("registered_total", "new_today", "dropped_today"),
        text_keys=("snap_date", "tld"),
    ),
    "companies": MergePolicy(
        keys=("canonical_domain",),
        schema=_schema(
            "name string, canonical_domain string, ticker string, exchange string, sec_cik string, "
            "industry string, in_sp500 boolean, in_russell1000 boolean, in_russell3000 boolean, "
            "in_us_public boolean, notes string"
        ),
        overwrite=("name", "in_sp500", "in_russell1000", "in_russell3000", "in_us_public"),
        keep=("ticker", "exchange", "sec_cik", "industry", "notes"),
        flags=("in_sp500", "in_russell1000", "in_russell3000", "in_us_public"),
        lower=("canonical_domain",),
        text_keys=("name", "canonical_domain"),
    ),
    "tranco_ranks": MergePolicy(
        keys=("domain", "snap_month"),
        schema=_schema("domain string, snap_month string, rank bigint"),
        overwrite=("rank",),
        lower=("domain",),
        text_keys=("domain", "snap_month"),
        number_keys=("rank",),
    ),
    "monthly_probe": MergePolicy(
        keys=("snap_month", "domain"),
        schema=T.StructType([*_schema("snap_month string, domain string").fields, *_PROBE_ATTRIBUTES.fields]),
        overwrite=tuple(_PROBE_ATTRIBUTES.fieldNames()),
        defaults={"probe_status": "ok"},
        lower=("domain",),
        text_keys=("snap_month", "domain"),
    ),
    "provider_dim": MergePolicy(
        keys=("provider_key",),
        schema=_schema("provider_key string, category string, display_name string, parent string, notes string"),
        overwrite=("category", "display_name"),
        keep=("parent", "notes"),
        text_keys=("provider_key", "category", "display_name"),
    ),
    "provider_share_monthly": MergePolicy(
        keys=("snap_month", "tier", "category", "provider_key"),
        schema=_schema(
            "snap_month string, tier string, category string, provider_key string, count bigint, "
            "total bigint, share double, delta_count bigint, delta_share double"
        ),
        overwrite=("count", "total", "share", "delta_count", "delta_share"),
        zero=("count", "total", "share"),
        text_keys=("snap_month", "tier", "category", "provider_key"),
    ),
    "registrar_tld_coverage": MergePolicy(
        keys=("iana_id", "tld"),
        schema=_schema(
            "iana_id bigint, tld string, carries boolean, first_year_cents bigint, renewal_cents bigint, "
            "transfer_cents bigint, restrictions string, last_verified_at string, source_url string"
        ),
        overwrite=(
            "carries",
            "first_year_cents",
            "renewal_cents",
            "transfer_cents",
            "restrictions",
            "last_verified_at",
            "source_url",
        ),
        flags=("carries",),
        text_keys=("tld",),
        number_keys=("iana_id",),
    ),
}


def prepare(batch: DataFrame, policy: MergePolicy) -> DataFrame:
    """Defaults, zeroes, 0/1 flags and lower-case keys of an incoming batch."""
    changed: dict[str, Column] = {}
    for name in policy.lower:
        changed[name] = F.lower(name)
    for name, default in policy.defaults.items():
        changed[name] = F.coalesce(F.col(name), F.lit(default))
    for name in policy.zero:
        changed[name] = F.coalesce(F.col(name), F.lit(0).cast(policy.schema[name].dataType))
    for name in policy.flags:
        changed[name] = flag(name).cast("boolean")
    return batch.withColumns({n: c for n, c in changed.items() if n in batch.columns})


def fold(ledger: DataFrame, policy: MergePolicy, seq: str | list[str] = "seq") -> DataFrame:
    """The table a ledger stands for: one row per key, rows taken in ``seq`` order.

    ``seq`` has to be a total order within a key. An ``applied_at`` column, if there is one,
    becomes ``updated_at``.
    """
    order = F.struct(*[F.col(s) for s in ([seq] if isinstance(seq, str) else seq)])
    present = set(ledger.columns)
    aggregates = [F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(c) for c in policy.add if c in present]
    overwrite = [c for c in policy.overwrite if c in present]
    if overwrite:
        aggregates.append(F.max_by(F.struct(*overwrite), order).alias("_last"))
    for name in policy.keep:
        if name in present:
            # A null order is ignored by max_by, so null values never win.
            aggregates.append(F.max_by(F.col(name), F.when(F.col(name).isNotNull(), order)).alias(name))
    if "applied_at" in present:
        aggregates.append(F.max("applied_at").alias("updated_at"))
    folded = ledger.groupBy(*policy.keys).agg(*aggregates)
    names = [f.name for f in policy.schema if f.name in present]
    columns = [F.col(f"_last.{n}").alias(n) if n in overwrite else F.col(n) for n in names]
    if "applied_at" in present:
        columns.append(F.col("updated_at"))
    return folded.select(*columns)


def upsert(current: DataFrame, batch: DataFrame, policy: MergePolicy, seq: str | list[str] = "seq") -> DataFrame:
    """``current`` (one row per key) after the rows of ``batch`` were applied in ``seq`` order."""
    steps = [seq] if isinstance(seq, str) else list(seq)
    names = [f.name for f in policy.schema if f.name in current.columns and f.name in batch.columns]
    old = current.select(*names, F.lit(0).alias("_gen"), *[F.lit(None).cast(batch.schema[s].dataType).alias(s) for s in steps])
    new = prepare(batch, policy).select(*names, F.lit(1).alias("_gen"), *steps)
    return fold(old.unionByName(new), policy, ["_gen", *steps])
