"""Append-only storage: idempotent writes, alignment, latest versions and audits as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with duplicate (a row of these keys came before)."""
    return rows.withColumn("duplicate", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1)


def insert_if_absent(stored: DataFrame, incoming: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, outcome): NEW where the key is absent, SAME where its content equals, COLLISION where it differs."""
    held = stored.select(F.col(key).alias("_key"), F.col(digest).alias("_digest"))
    j = incoming.join(held, incoming[key] == held["_key"], "left")
    return j.select(key, F.when(F.col("_key").isNull(), "NEW").when(F.col("_digest").eqNullSafe(F.col(digest)), "SAME").otherwise("COLLISION").alias("outcome"))


def latest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The last row of each key by descending order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_r = 1").drop("_r")


def effective(original: DataFrame, versions: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """original with columns replaced by those of its version, where there is one."""
    v = versions.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns])
    j = original.join(v, original[key] == v["_key"], "left")
    keep = [original[c] for c in original.columns if c not in columns]
    return j.select(*keep, *[F.coalesce(F.col(f"_{c}"), original[c]).alias(c) for c in columns], F.col("_key").isNotNull().alias("revised"))


def align(first: DataFrame, second: DataFrame, key: str, batch: str, digest: str) -> DataFrame:
    """Anomalies between two phases' result sets: MISSING, EXTRA, CROSS_BATCH, HASH_DISCONTINUITY."""
    a = first.select(F.col(key).alias("k1"), F.col(batch).alias("b1"), F.col(digest).alias("h1"))
    b = second.select(F.col(key).alias("k2"), F.col(batch).alias("b2"), F.col(digest).alias("h2"))
    j = a.join(b, F.col("k1") == F.col("k2"), "full")
    code = F.when(F.col("k2").isNull(), "MISSING").when(F.col("k1").isNull(), "EXTRA").when(F.col("b1") != F.col("b2"), "CROSS_BATCH").when(~F.col("h1").eqNullSafe(F.col("h2")), "HASH_DISCONTINUITY")
    return j.select(F.coalesce("k1", "k2").alias(key), code.alias("anomaly")).filter("anomaly is not null")


def violations(rows: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule (a condition that must hold) a row breaks; null counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(*key, F.explode(broken).alias("rule"))


def not_unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(child: DataFrame, parent: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Child rows whose (non-null) reference has no parent; keys: child column -> parent column."""
    p = parent.select(*[F.col(v).alias(f"_{v}") for v in keys.values()]).distinct()
    on = [child[c] == p[f"_{v}"] for c, v in keys.items()]
    present = [child[c].isNotNull() for c in keys]
    filtered = child
    for ok in present:
        filtered = filtered.filter(ok)
    return filtered.join(p, on, "left_anti")


def snapshot_changes(before: DataFrame, after: DataFrame, key: str, frozen: list[str]) -> DataFrame:
    """(key, change): DELETED rows and CHANGED:<column> for columns that must not change."""
    a = before.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in frozen])
    b = after.select(F.col(key).alias("_a"), *[F.col(c).alias(f"_new_{c}") for c in frozen])
    gone = F.col("_a").isNull()
    changed = [F.when(~gone & ~F.col(f"_{c}").eqNullSafe(F.col(f"_new_{c}")), F.lit(f"CHANGED:{c}")) for c in frozen]
    found = F.array_compact(F.array(F.when(gone, F.lit("DELETED")), *changed))
    return a.join(b, F.col("_k") == F.col("_a"), "left").select(F.col("_k").alias(key), F.explode(found).alias("change"))


def manifest(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, artifacts, bytes, digest): count, size and a digest over the sorted digests of a document's artifacts."""
    each = F.sha2(F.encode(text, "UTF-8"), 256)
    return rows.groupBy(key).agg(F.count("*").alias("artifacts"), F.sum(F.octet_length(F.encode(text, "UTF-8"))).alias("bytes"), F.sha2(F.encode(F.array_join(F.array_sort(F.collect_list(each)), "|"), "UTF-8"), 256).alias("digest"))


def verify_manifest(stored: DataFrame, computed: DataFrame, key: str) -> DataFrame:
    """(key, fault) where counts, sizes or digests disagree or a side is missing."""
    a = stored.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in ("artifacts", "bytes", "digest")])
    j = a.join(computed, a["_k"] == computed[key], "full")
    fault = F.when(F.col(key).isNull(), "ARTIFACT_MISSING").when(F.col("_k").isNull(), "NOT_IN_MANIFEST").when(F.col("_artifacts") != F.col("artifacts"), "COUNT").when(F.col("_bytes") != F.col("bytes"), "SIZE").when(F.col("_digest") != F.col("digest"), "DIGEST")
    return j.select(F.coalesce("_k", key).alias(key), fault.alias("fault")).filter("fault is not null")


def for_tenant(rows: DataFrame, tenant: str) -> DataFrame:
    """Rows of one tenant; partition the tables by tenant_id and this prunes files."""
    return rows.filter(F.col("tenant_id") == tenant)


def tenant_leaks(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys whose rows belong to different tenants in two tables."""
    o = b.select(F.col(key).alias("_k"), F.col("tenant_id").alias("_t"))
    return a.join(o, a[key] == o["_k"]).filter(F.col("tenant_id") != F.col("_t")).select(key, "tenant_id", F.col("_t").alias("other_tenant"))
