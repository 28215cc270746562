"""Rights as joins: which sources may be processed, and what their provenance says."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Permissions that each run mode needs, and the tier of each rights basis.
MODE_PERMISSIONS = {
    "analysis": ("analysis", "derivative_artifact_retention"),
    "evaluation": ("analysis", "evaluation", "derivative_artifact_retention"),
}
BASIS_TIERS = {
    "synthetic-controlled": "D-synthetic-controlled",
    "public-domain": "A-clear-training-rights",
    "licensed": "A-clear-training-rights",
    "owned": "C-private-user-accessible",
    "other-documented-authorization": "C-private-user-accessible",
}
_ZONED = r"(Z|[+-]\d{2}:?\d{2}(:?\d{2})?)$"
_INSTANT = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:?\d{2}(:?\d{2}([.,]\d+)?)?)?)?" + _ZONED[:-1] + "?$"


def _instant(text: Column) -> Column:
    return F.try_to_timestamp(F.replace(text, F.lit("Z"), F.lit("+00:00")))


def _one_per_source(rights: DataFrame) -> DataFrame:
    """One row per content hash and source: how many declarations the pair has, and one of them as ``_d``."""
    keys = ["content_sha256", "source_id"]
    rest = F.struct(*[c for c in rights.columns if c not in keys])
    return rights.groupBy(*keys).agg(F.count(F.lit(1)).alias("_declarations"), F.any_value(rest).alias("_d"))


def rights_gate(
    sources: DataFrame,
    rights: DataFrame,
    mode: str,
    as_of: str,
    extra_permissions: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Split sources into allowed and denied (with the first failing reason).

    A declaration counts only for the exact content hash and source id; sources of one content may have
    one each. No declaration, one that is bound to other sources only, more than one for a pair of
    hash and source (whatever they say), a missing permission, a malformed or zone-less expiry, or one
    at or before ``as_of`` denies.
    """
    if mode not in MODE_PERMISSIONS:
        raise ValueError(f"unknown run mode: {mode}")
    needed = [*MODE_PERMISSIONS[mode], *extra_permissions]
    declared = _one_per_source(rights).select(
        "content_sha256", "source_id", "_d.permissions", "_d.expires_at", "_d.rights_basis", "_d.manifest_hash",
        "_declarations",
    )
    anywhere = rights.groupBy("content_sha256").agg(F.lit(True).alias("_declared"))
    joined = sources.join(declared, ["content_sha256", "source_id"], "left").join(anywhere, "content_sha256", "left")
    expiry = F.col("expires_at")
    lacks = [
        F.when(~F.coalesce(F.col("permissions").getItem(name), F.lit(False)), F.lit(f"not_permitted:{name}"))
        for name in needed
    ]
    reason = F.coalesce(
        F.when(F.col("_declared").isNull(), F.lit("no_declaration")),
        F.when(F.col("_declarations").isNull(), F.lit("not_bound_to_source")),
        F.when(F.col("_declarations") > 1, F.lit("ambiguous_declaration")),
        F.when(~F.col("rights_basis").isin(list(BASIS_TIERS)), F.lit("unknown_basis")),
        *lacks,
        F.when(
            expiry.isNotNull() & (~expiry.rlike(_INSTANT) | (expiry.rlike(_ZONED) & _instant(expiry).isNull())),
            F.lit("expiry_malformed"),
        ),
        F.when(expiry.isNotNull() & ~expiry.rlike(_ZONED), F.lit("expiry_without_zone")),
        F.when(_instant(expiry) <= F.lit(as_of).cast("timestamp"), F.lit("expired")),
    )
    judged = joined.withColumn("reason", reason)
    kept = [c for c in sources.columns]
    return (
        judged.filter("reason is null").select(*kept, "manifest_hash"),
        judged.filter("reason is not null").select(*kept, "reason"),
    )


def provenance(sources: DataFrame, rights: DataFrame) -> DataFrame:
    """Tier, permitted uses, retention and review status of each source with one declaration.

    A pair of content hash and source with several declarations has no provenance, as the gate denies it.
    """
    tiers = F.create_map(*[F.lit(x) for pair in BASIS_TIERS.items() for x in pair])
    retained = F.coalesce(
        F.col("permissions").getItem("derivative_artifact_retention"), F.lit(False)
    )
    single = _one_per_source(rights).filter("_declarations = 1").select("content_sha256", "source_id", "_d.*")
    return sources.join(single, ["source_id", "content_sha256"]).select(
        "source_id",
        "content_sha256",
        tiers[F.col("rights_basis")].alias("rights_tier"),
        F.concat(F.lit("operator-declared:"), F.col("rights_basis")).alias("acquisition_basis"),
        F.map_keys(F.map_filter("permissions", lambda _, allowed: allowed)).alias("permitted_uses"),
        "restrictions",
        F.when(retained, F.lit("derivative-retention-permitted"))
        .otherwise(F.lit("derivative-retention-not-permitted")).alias("retention"),
        F.col("source_id").alias("deletion_key"),
        F.when(F.col("independently_reviewed"), F.lit("independently-reviewed"))
        .otherwise(F.lit("operator-declared-not-independently-reviewed")).alias("review_status"),
    )
