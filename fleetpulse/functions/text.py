"""Names, labels and the JSON cells of recordings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fleetpulse.schema import U64

_STYLES = ("rollup", "exposition", "driver")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sanitize_name(name, style: str = "rollup") -> Column:
    """Metric names as the roll-up table, the exposition text or driver stats spell them."""
    name = _col(name)
    if style == "rollup":
        return F.translate(name, "/", "_")
    if style == "exposition":
        return F.translate(name, "/-", "__")
    if style == "driver":
        return F.regexp_replace(name, r"[^\p{L}\p{Nd}_]", "_")
    raise ValueError(f"style must be one of {_STYLES}")


def sorted_labels(labels) -> Column:
    """The label map rebuilt in key order."""
    return F.map_from_entries(F.array_sort(F.map_entries(_col(labels))))


def encode_labels(labels) -> Column:
    """Labels as JSON with sorted keys; two maps are equal iff their texts are."""
    return F.coalesce(F.to_json(sorted_labels(labels)), F.lit("{}"))


def decode_labels(text) -> Column:
    return F.from_json(_col(text), "map<string,string>")


def series_key(name, labels) -> Column:
    """Compact series id that does not depend on label order."""
    return F.xxhash64(_col(name), encode_labels(labels))


def encode_buckets(buckets) -> Column:
    """``[[bound,count],...]``"""
    return F.to_json(F.transform(_col(buckets), lambda b: F.array(b["bound"], b["count"])))


def decode_buckets(text) -> Column:
    """Parsed pairs in DECIMAL(20,0), so that unsigned 64-bit counts survive; null if malformed."""
    pairs = F.from_json(_col(text), "array<array<decimal(20,0)>>")
    shaped = F.forall(pairs, lambda p: (F.size(p) == 2) & p[0].isNotNull() & p[1].isNotNull())
    return F.when(shaped, F.transform(pairs, lambda p: F.struct(
        p[0].cast(U64).alias("bound"), p[1].cast(U64).alias("count"))))


def percentile_text(p: float) -> str:
    return str(int(p)) if float(p).is_integer() else repr(float(p))


def escape_label(value) -> Column:
    value = F.replace(_col(value), F.lit("\\"), F.lit("\\\\"))
    value = F.replace(value, F.lit('"'), F.lit('\\"'))
    return F.replace(value, F.lit("\n"), F.lit("\\n"))


def label_text(labels, percentile=None) -> Column:
    """``{k="v",...}`` in key order, the percentile last; empty text without labels."""
    parts = F.transform(F.array_sort(F.map_entries(_col(labels))), lambda e: F.concat(
        e["key"], F.lit('="'), escape_label(e["value"]), F.lit('"')))
    if percentile is not None:
        extra = F.concat(F.lit('percentile="'), _col(percentile), F.lit('"'))
        parts = F.when(_col(percentile).isNotNull(), F.array_append(parts, extra)).otherwise(parts)
    return F.when(F.size(parts) > 0, F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))).otherwise(F.lit(""))


def normalize_mask(mask) -> Column:
    """CPU mask without commas and leading zeros; ``0`` for an empty one."""
    bare = F.regexp_replace(F.translate(F.trim(_col(mask)), ",", ""), "^0+", "")
    return F.when(bare == "", F.lit("0")).otherwise(bare)
