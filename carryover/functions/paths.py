"""Storage paths: parse, map to the target layout, find embedded credentials."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# scheme, target kind, compatibility (fixed values)
SCHEMES = [
    ("gs", "onelake_shortcut", "transform"),
    ("hdfs", "none", "redesign"),
    ("wasb", "onelake_shortcut", "transform"),
    ("wasbs", "onelake_shortcut", "transform"),
    ("abfs", "onelake_shortcut", "transform"),
    ("abfss", "onelake_shortcut", "transform"),
    ("s3", "none", "redesign"),
    ("s3a", "none", "redesign"),
]

# credential shapes inside a path (fixed values)
PATH_CREDENTIAL = r"[?&](key|password|secret|token|api_key)=|://\w+:\w+@"


def path_parts(path: Column) -> tuple[Column, Column, Column]:
    """Scheme, bucket (or container) and key."""
    scheme = F.regexp_extract(path, r"^([a-z0-9]+)://", 1)
    bucket = F.regexp_extract(path, r"^[a-z0-9]+://([^/@]+)", 1)
    key = F.regexp_extract(path, r"^[a-z0-9]+://[^/]+/(.*)$", 1)
    return scheme, bucket, key


def map_path(path: Column) -> Column:
    """Struct(kind, compatibility, target): object-store buckets become shortcut paths,
    foreign stores need a redesign, unknown schemes are never guessed."""
    scheme, bucket, key = path_parts(path)
    kind, compat = F.lit("none"), F.lit("unknown")
    for s, k, c in SCHEMES:
        kind = F.when(scheme == s, k).otherwise(kind)
        compat = F.when(scheme == s, c).otherwise(compat)
    broken = (scheme == "gs") & ((bucket == "") | ~path.rlike("^gs://[^/]+/"))
    target = F.when((scheme == "gs") & ~broken, F.concat(F.lit("/Shortcuts/gcs_"), bucket, F.lit("/"), key)).otherwise("")
    return F.struct(
        F.when(broken, "none").otherwise(kind).alias("kind"),
        F.when(broken, "unsupported").otherwise(compat).alias("compatibility"),
        target.alias("target"))


def has_credentials(path: Column) -> Column:
    return path.rlike(PATH_CREDENTIAL)
