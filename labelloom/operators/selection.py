"""Filters over screenings, reviews, caches and logs, and keyed reads and writes of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DEMO_IDS = ("1", "2", "3")


def exclude_demo(s: DataFrame) -> DataFrame:
    """Without synthetic rows: ids like demo-% in any case, or 1, 2, 3."""
    i = F.col("id").cast("string")
    return s.filter(~i.ilike("demo-%") & ~i.isin(*DEMO_IDS))


def purge_test(s: DataFrame) -> DataFrame:
    """Without test rows; in test_% the underscore stands for any character, as LIKE has it."""
    i = F.col("id").cast("string")
    return s.filter(~(i.ilike("test-%") | i.ilike("test_%") | i.ilike("demo-%") | i.isin(*DEMO_IDS)))


def search(s: DataFrame, text: str = "", status: str = "", organization: int | None = None, limit: int = 50, columns: tuple[str, ...] = ("product_name", "id")) -> DataFrame:
    """Rows with the trimmed text in one of the columns, in any case, and the status; newest first."""
    q = text.strip().lower()
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(F.col(c).cast("string")).contains(q)
    out = s.filter(hit) if q else s
    out = out.filter(F.upper("status").contains(status.strip().upper())) if status else out
    out = out.filter(F.col("organization") == organization) if organization is not None else out
    return out.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def in_scope(role: Column, organization: Column, name: Column) -> Column:
    """Whether a principal may see a row: fail-closed, by role, organization and, for merchants, owner."""
    same = organization.isNotNull() & (F.col("organization") == organization)
    own = F.lower(F.trim(F.col("owner"))) == F.lower(F.trim(name))
    return F.coalesce(
        F.when(role == "ADMIN", True).when(role.isin("ENFORCEMENT_OFFICER", "AUDIT_OFFICER"), same).when(role == "MERCHANT_PUBLIC", same & own).otherwise(False),
        F.lit(False),
    )


def scope(df: DataFrame, role: str, organization: int | None = None, name: str | None = None) -> DataFrame:
    return df.filter(in_scope(F.lit(role), F.lit(organization), F.lit(name)))


def scope_many(df: DataFrame, principals: DataFrame) -> DataFrame:
    """(principal, id) that each of a table of principals may see.

    Officers and merchants join on organization, so only administrators read every
    row; principals are few, and are broadcast up to a checked count.
    """
    from labelloom.operators.common import small

    p = small(principals.toDF(*(f"p_{c}" for c in principals.columns)))
    tied = df.join(p.filter("p_role <> 'ADMIN'"), F.col("organization") == F.col("p_organization"))
    free = df.join(p.filter("p_role = 'ADMIN'"), how="cross")
    see = in_scope(F.col("p_role"), F.col("p_organization"), F.col("p_name"))
    return tied.filter(see).unionByName(free).select(F.col("p_name").alias("principal"), *df.columns)


def scope_timeline(df: DataFrame, organization: int) -> DataFrame:
    """The older rule of timelines: rows of the organization or of none."""
    return df.filter((F.col("organization") == organization) | F.col("organization").isNull())


def owned_by(df: DataFrame, name: str, key: str | None = None) -> DataFrame:
    return df.filter((F.lower("owner") == name.lower()) | (F.col("owner") == (key or name)))


def match_product(s: DataFrame, name: str) -> DataFrame:
    """Rows whose product is the name, or where none is, rows whose product contains it."""
    q, p = name.strip().lower(), F.lower(F.trim("product_name"))
    ranked = s.withColumn("__rank", F.when(p == q, 0).when(p.contains(q), 1)).filter("__rank IS NOT NULL")
    best = ranked.agg(F.min("__rank").alias("__best"))
    return ranked.join(F.broadcast(best), F.col("__rank") == F.col("__best")).drop("__rank", "__best")  # one row


def reviews(r: DataFrame, status: str = "", officer: str = "", risk: str = "", organization: int | None = None, limit: int = 100) -> DataFrame:
    """Review queue filter; PENDING means PENDING_REVIEW and VERIFIED every verified status. Newest first."""
    s = status.strip().upper()
    if s:
        r = r.filter(F.col("status").startswith("VERIFIED") if s == "VERIFIED" else F.col("status") == ("PENDING_REVIEW" if s == "PENDING" else s))
    r = r.filter(F.lower("officer") == officer.lower()) if officer else r
    r = r.filter(F.upper("risk_level") == risk.upper()) if risk else r
    r = r.filter(F.col("organization") == organization) if organization is not None else r
    return r.orderBy(F.desc("updated_at"), F.desc("review_id")).limit(limit)


def rules(r: DataFrame, domain: str = "", category: str = "") -> DataFrame:
    """Rules of a domain that apply to a category (column categories; ALL fits any)."""
    r = r.filter(F.upper("domain") == domain.upper()) if domain else r
    return r.filter(F.array_contains("categories", "ALL") | F.array_contains("categories", category.upper())) if category else r


def claim_rules(r: DataFrame, category: str = "", risk: str = "") -> DataFrame:
    r = r.filter(F.upper("category") == category.upper()) if category else r
    return r.filter(F.upper("risk_level") == risk.upper()) if risk else r


def cache_valid(cache: DataFrame, now: str) -> DataFrame:
    """The last row of each key, if it hasn't expired. cache: identifier_type, identifier_value, cached_at, ttl in seconds."""
    return latest(cache, ["identifier_type", "identifier_value"], "cached_at", "event_id").filter(expires() > F.lit(now).cast("timestamp"))


def cache_expired(cache: DataFrame, now: str) -> DataFrame:
    return latest(cache, ["identifier_type", "identifier_value"], "cached_at", "event_id").filter(expires() <= F.lit(now).cast("timestamp"))


def expires() -> Column:
    return F.timestamp_seconds(F.unix_micros("cached_at") / 1000000 + F.col("ttl"))


def audit(log: DataFrame, kind: str | None = None, limit: int = 100, by: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Newest log rows, of one kind or all."""
    log = log.filter(F.col("event_type") == kind) if kind else log
    return log.orderBy(*map(F.desc, by)).limit(limit)


def get_many(df: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    return df.join(keys, list(on), "left_semi")


def delete(df: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    return df.join(keys, list(on), "left_anti")


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key, ties by the later columns of order."""
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(*map(F.desc, order)))
    return df.withColumn("__rn", rn).filter("__rn = 1").drop("__rn")


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """base with updates written over it; for each key the last row by order wins, and an update beats the base on ties."""
    both = base.withColumn("__new", F.lit(0)).unionByName(updates.withColumn("__new", F.lit(1)))
    return latest(both, keys, *order, "__new").drop("__new")


def newest(df: DataFrame, limit: int, by: tuple[str, ...] = ("created_at", "id")) -> DataFrame:
    return df.orderBy(*map(F.desc, by)).limit(limit)
