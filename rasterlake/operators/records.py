"""Annotation records, scene audits and reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the audit's fields, and those that statistics decide
PROGRAMMATIC_FIELDS = ["brightness_level", "illumination_level", "dynamic_range_level", "highlight_strength", "dark_region_ratio_level"]
AUDIT_FIELDS = [
    "scene_category", "layout_plausibility", "functional_coherence", "object_arrangement_coherence", "lighting_naturalness", "brightness_level", "illumination_level", "dynamic_range_level",
    "highlight_strength", "shadow_strength", "dark_region_ratio_level", "lighting_challenge_type", "overall_plausibility", "confidence", "issues", "reason_short",
]


def record_errors(record: Column) -> Column:
    """Ordered errors of a record (JSON text): required keys, physical properties within that key, numeric ones.

    Booleans pass as numbers, numbers in quotes don't; properties that aren't an object
    hold none, and text that isn't JSON lacks every key.
    """
    whole = F.try_parse_json(record)
    value = lambda path: F.try_variant_get(whole, path, "variant")
    number = lambda path: F.coalesce(F.schema_of_variant(value(path)).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|BOOLEAN)"), F.lit(False))
    own = "$.physical_properties"
    checks = [F.when(value(f"$.{k}").isNull(), f"missing key: {k}") for k in ("sample_id", "image_path", "physical_properties")]
    checks += [F.when(value(f"{own}.{k}").isNull(), f"missing physical property: {k}") for k in ("albedo", "roughness", "metallic")]
    checks += [F.when(value(f"{own}.{k}").isNotNull() & ~number(f"{own}.{k}"), f"{k} must be numeric") for k in ("roughness", "metallic")]
    return F.array_compact(F.array(*checks))


def with_defaults(parsed: Column) -> dict[str, Column]:
    """An analysis's five fields from its JSON text: missing ones empty, single notes as lists, a malformed view list empty."""
    get = lambda path: F.get_json_object(parsed, f"$.{path}")
    as_list = lambda v: F.when(v.isNull(), F.array().cast("array<string>")).when(v.startswith("["), F.from_json(v, "array<string>")).otherwise(F.array(v))
    views = F.when(
        get("per_view").startswith("["), F.from_json(get("per_view"), "array<struct<image_name:string,albedo_hint:string>>")
    ).otherwise(F.array().cast("array<struct<image_name:string,albedo_hint:string>>"))
    return {
        "scene_summary": F.coalesce(get("scene_summary"), F.lit("")), "material_notes": as_list(get("albedo_material_notes")), "lighting_notes": as_list(get("albedo_lighting_notes")),
        "prompt_suffix": F.coalesce(get("albedo_prompt_suffix"), F.lit("")), "per_view": views,
    }


def hint_of(views: Column, image: Column) -> Column:
    """The hint of an image in a list of (image_name, hint); the last entry counts."""
    return F.coalesce(F.try_element_at(F.filter(views, lambda v: (v["image_name"] == image) & (v["image_name"] != "")), F.lit(-1))["albedo_hint"], F.lit(""))


def disagreement(rows: DataFrame, keys: list[str], field: str, value: str) -> DataFrame:
    """Fields for which a scene's auditors gave more than one distinct value, from rows (keys, field, value)."""
    per = rows.groupBy(*keys, field).agg(F.count("*").alias("n_votes"), F.size(F.collect_set(value)).alias("n_distinct"))
    return per.groupBy(*keys).agg(
        F.count("*").alias("n_fields"), F.count_if(F.col("n_distinct") > 1).alias("n_disagreeing"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("n_distinct") > 1, F.col(field)))), ",").alias("fields")
    )


def review_context(merged: DataFrame, fields: list[str], disagreeing: str) -> Column:
    """What a reviewer is sent: chosen fields and the disagreeing ones."""
    return F.to_json(F.struct(*[F.col(f) for f in fields if f in merged.columns], F.col(disagreeing)))


def preserve(final: DataFrame, merged: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Fields that statistics decide, taken from the merged record where it has them."""
    m = merged.select(*keys, *[F.col(f).alias(f"__m_{f}") for f in fields])
    out = final.join(m, keys, "left")
    return out.select(*[F.coalesce(F.col(f"__m_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in final.columns])


def complete(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Missing fields filled: no issues, confidence 0, anything else uncertain."""
    fill = {"issues": F.array().cast("array<string>"), "confidence": F.lit(0.0)}
    present = set(rows.columns)
    return rows.withColumns({f: F.coalesce(F.col(f), fill.get(f, F.lit("uncertain"))) if f in present else fill.get(f, F.lit("uncertain")) for f in fields})


def baseline_records(rows: DataFrame) -> DataFrame:
    """Records under the names that comparisons use."""
    return rows.select(F.col("sample_id").alias("id"), F.col("image_path").alias("image"), F.col("physical_properties").alias("targets"))


def baseline_metrics(metrics: Column) -> dict[str, Column]:
    """A comparison's two metrics from JSON text; missing ones are 0."""
    return {m: F.coalesce(F.get_json_object(metrics, f"$.{m}").try_cast("double"), F.lit(0.0)) for m in ("mae", "rmse")}


def completed_scene(text: Column) -> Column:
    """Whether a scene's saved answer is an object without an error."""
    error = F.coalesce(F.get_json_object(text, "$.error"), F.lit(""))
    return F.json_object_keys(text).isNotNull() & error.isin("", "false", "0", "[]", "{}")
