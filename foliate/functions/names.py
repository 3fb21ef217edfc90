"""Identifiers, path segments and paths as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

COMPACT, DASHED = "[0-9a-f]{32}", "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
#: The longest segment, characters that become a dash, and reserved names.
LONGEST, DANGEROUS = 200, '/\\:*?"<>|'
RESERVED = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(?:\.|$)"
EXTENSIONS = {"image/jpeg": ".jpg", "image/png": ".png", "image/gif": ".gif", "image/webp": ".webp", "image/svg+xml": ".svg", "application/pdf": ".pdf"}


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def nfc(text: Column) -> Column:
    """Canonical composition; pure ASCII never leaves the JVM's value unchanged by it, but Spark has no function for the rest."""
    return _nfc(text)


def is_dashed(v: Column) -> Column:
    return v.rlike(f"(?i)^{DASHED}$")


def normal_id(v: Column) -> Column:
    return F.when(v.rlike(f"(?i)^(?:{COMPACT}|{DASHED})$"), F.lower(F.replace(v, F.lit("-"), F.lit(""))))


def trailing_id(v: Column) -> Column:
    return normal_id(F.nullif(F.regexp_extract(v, f"(?i)(?:{COMPACT}|{DASHED})$", 0), F.lit("")))


def short_id(v: Column) -> Column:
    return F.coalesce(F.nullif(F.substring(F.replace(v, F.lit("-"), F.lit("")), 1, 8), F.lit("")), F.lit("unknown"))


def with_suffix(base: Column, ident: Column) -> Column:
    suffix = F.concat(F.lit("--"), short_id(ident))
    return F.concat(F.substring(base, F.lit(1), F.lit(LONGEST) - F.length(suffix)), suffix)


def segment(title: Column, ident: Column, composed: bool = True) -> Column:
    """A title as a path segment; ``composed`` skips the composition of text known to be composed."""
    text = title if composed else nfc(title)
    dashed = F.translate(text, DANGEROUS, "-" * len(DANGEROUS))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(dashed, r"[\x00-\x1F\x7F]", "-"), r"^\s+|\s+$", ""), r"[. ]+$", "")
    safe = F.when(bare.rlike(RESERVED), F.concat(F.lit("_"), bare)).otherwise(bare)
    return F.when(bare == "", F.concat(F.lit("Untitled--"), short_id(ident))).otherwise(F.when(F.length(safe) > LONGEST, with_suffix(safe, ident)).otherwise(safe))


def collision_key(path: Column, composed: bool = True) -> Column:
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.lower(slashed if composed else nfc(slashed))


def extension(path: Column) -> Column:
    """The last dot and what follows it in the last segment, unless the dot begins it."""
    return F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)


def stem(path: Column) -> Column:
    return F.substring(path, F.lit(1), F.length(path) - F.length(extension(path)))


def beside(path: Column, ident: Column) -> Column:
    """The path that a colliding one falls back to."""
    return F.concat(stem(path), F.lit("--"), F.substring(F.replace(ident, F.lit("-"), F.lit("")), 1, 8), extension(path))


def within_root(path: Column) -> Column:
    """Whether a relative path, its dots resolved, stays below its root."""
    depth = F.aggregate(
        F.split(path, "/"), F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")),
        lambda a, s: F.when(s.isin("", "."), a).otherwise(F.struct((a["at"] + F.when(s == "..", -1).otherwise(1)).alias("at"), F.least(a["low"], a["at"] + F.when(s == "..", -1).otherwise(1)).alias("low"))),
    )
    return ~path.startswith("/") & (depth["low"] >= 0)


def relative(source: Column, target: Column) -> Column:
    """The way from the folder of ``source`` to ``target``."""
    a, b = F.slice(F.split(source, "/"), 1, F.size(F.split(source, "/")) - 1), F.split(target, "/")
    same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1))), lambda n: (n <= F.size(a)) & (F.slice(a, F.lit(1), n) == F.slice(b, F.lit(1), n))))
    return F.concat(F.repeat(F.lit("../"), F.size(a) - same), F.array_join(F.slice(b, same + 1, F.size(b)), "/"))


def asset_path(page: Column, block: Column, name: Column, mime: Column) -> Column:
    ext = extension(name)
    mapped = F.element_at(F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv)), F.lower(mime))
    suffix = F.when(ext.rlike(r"(?i)^\.[a-z0-9]{1,10}$"), F.lower(ext)).otherwise(F.coalesce(mapped, F.lit("")))
    bare = F.coalesce(F.nullif(stem(name), F.lit("")), F.lit("asset"))
    return F.concat(F.lit("_assets/"), segment(page, page), F.lit("/"), segment(block, block), F.lit("--"), segment(bare, block), suffix)


def asset_key(page: Column, block: Column) -> Column:
    return F.concat(page, F.lit(":"), block)


def external_block(url: Column) -> Column:
    return F.concat(F.lit("external-"), F.substring(F.sha2(url, 256), 1, 16))


def sidecar_path(page: Column, ident: Column) -> Column:
    return F.concat(F.lit("_unsupported/"), segment(page, page), F.lit("/"), segment(ident, ident), F.lit(".json"))


def structure_hash(root: Column, parent: Column, path: Column) -> Column:
    """An absent parent is left out of the hashed JSON."""
    return F.sha2(F.to_json(F.struct(root.alias("rootId"), parent.alias("parentId"), path.alias("expectedPath"))), 256)
