"""Clamp proposed settings and apply them to a configuration."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions.text import float_text
from textquarry.sources.tiers import BOUNDS

Bounds = Mapping[str, tuple[float, float, bool]]


def bounds_table(bounds: Bounds = BOUNDS) -> Column:
    """Literal array of ``struct<key, lo, hi, whole>``; a handful of constants needs no join."""
    rows = [
        f"struct('{key}' AS key, {float(lo)!r}D AS lo, {float(hi)!r}D AS hi, {whole} AS whole)"
        for key, (lo, hi, whole) in bounds.items()
    ]
    return F.expr(f"array({', '.join(rows)})")


def clamp(value: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(lo, F.least(hi, value))


def tunable(config: Column | str, bounds: Bounds = BOUNDS) -> Column:
    """The entries of a settings map that a proposal may change."""
    config = F.col(config) if isinstance(config, str) else config
    names = F.array(*[F.lit(k) for k in bounds])
    return F.map_filter(config, lambda k, _: F.array_contains(names, k))


def number_text(value: Column, whole: Column) -> Column:
    """A number as configuration logs show it: ``16`` when whole, else ``16.5`` or ``5e-05``."""
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(float_text(value))


def patch_changes(config: Column, patch: Column, bounds: Bounds = BOUNDS) -> Column:
    """``array<struct<key, current, stored, change>>``, one per tunable key of ``patch``.

    ``change`` is the log line, null when nothing changed. Keys come in bounds order.
    """

    def look_up(bound: Column) -> Column:
        proposed = F.try_element_at(patch, bound["key"])
        return F.struct(
            bound.alias("bound"),
            F.try_element_at(config, bound["key"]).alias("current"),
            F.schema_of_variant(proposed).alias("kind"),
            F.coalesce(
                F.try_variant_get(proposed, "$", "double"),
                F.try_variant_get(proposed, "$", "boolean").cast("int").cast("double"),
            ).alias("value"),
        )

    def compare(s: Column) -> Column:
        numeric = s["kind"].isin("BIGINT", "DOUBLE", "FLOAT", "BOOLEAN")
        numeric = numeric | s["kind"].startswith("DECIMAL")
        bound, value = s["bound"], s["value"]
        clamped = clamp(value, bound["lo"], bound["hi"])
        # A value inside its bounds keeps its own form in the log, one at a bound has the bound's.
        inside = (value > bound["lo"]) & (value < bound["hi"])
        return F.struct(
            bound["key"].alias("key"),
            bound["whole"].alias("whole"),
            s["current"].alias("current"),
            clamped.alias("clamped"),
            (inside & (s["kind"] == "BOOLEAN")).alias("as_bool"),
            F.when(inside, s["kind"] == "BIGINT").otherwise(bound["whole"]).alias("as_whole"),
            (numeric & (s["current"].isNull() | (clamped != s["current"]))).alias("changed"),
        )

    def describe(s: Column) -> Column:
        shown = F.when(s["as_bool"], "True").otherwise(number_text(s["clamped"], s["as_whole"]))
        before = F.coalesce(number_text(s["current"], s["whole"]), F.lit("None"))
        line = F.concat(F.lit("  "), s["key"], F.lit(": "), before, F.lit(" → "), shown)
        whole = F.when(s["current"].isNull(), s["as_whole"]).otherwise(s["whole"])
        # Whole settings are cut towards zero; none is negative.
        stored = F.when(whole, F.floor(s["clamped"]).cast("double")).otherwise(s["clamped"])
        return F.struct(
            s["key"],
            s["current"],
            F.when(s["changed"], stored).otherwise(s["current"]).alias("stored"),
            F.when(s["changed"], line).alias("change"),
        )

    asked = F.filter(bounds_table(bounds), lambda b: F.map_contains_key(patch, b["key"]))
    return F.transform(F.transform(F.transform(asked, look_up), compare), describe)


def apply_patch(
    df: DataFrame, config: str = "config", patch: str = "patch", bounds: Bounds = BOUNDS
) -> DataFrame:
    """Add ``new_config`` (``map<string,double>``) and ``changes`` (log lines).

    Keys outside ``bounds`` and values that are not numbers are ignored; whole settings stay whole.
    """
    made = F.filter(
        patch_changes(F.col(config), F.col(patch), bounds), lambda c: c["change"].isNotNull()
    )
    changed = F.map_from_entries(
        F.transform("_made", lambda c: F.struct(c["key"], c["stored"]))
    )
    kept = F.map_filter(
        F.col(config), lambda k, _: ~F.array_contains(F.col("_made.key"), k)
    )
    return df.withColumn("_made", made).select(
        *df.columns,
        F.map_concat(kept, changed).alias("new_config"),
        F.col("_made.change").alias("changes"),
    )


def patch_rows(
    df: DataFrame,
    keys: Sequence[str],
    config: str = "config",
    patch: str = "patch",
    bounds: Bounds = BOUNDS,
) -> DataFrame:
    """``(keys, key, current, stored, change)``, one row per tunable key of the patch."""
    changes = patch_changes(F.col(config), F.col(patch), bounds)
    rows = df.select(*keys, F.explode_outer(changes).alias("c"))
    return rows.where(F.col("c").isNotNull()).select(*keys, "c.*")
