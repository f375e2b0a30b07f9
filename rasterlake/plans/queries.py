"""Registered queries: each operator applied to the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import paths as P
from ..functions import texts as X
from ..operators import images, manifest, matching, pixels, records, settings, tiles
from ..operators.settings import DepthSettings
from ..sources.tables import SIDE, embedding_maps, lineitem_pixels, table
from . import file_queries, more_queries

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` places (no negative zero), non-finite ones null: comparable between engines."""
    return df.select(*[(F.round(N.finite(F.col(c)), digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _pixels(spark, sf_dir, shift=0.0, *more):
    keys = ["image", *more]
    return pixels.explode_maps(embedding_maps(spark, sf_dir, shift), keys, SIDE)


# masked errors


@query
def masked_error_per_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pixels.masked_errors(_pixels(spark, sf_dir), ["image"]))


@query
def error_macro_micro_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pixels.masked_errors(_pixels(spark, sf_dir, 0.0, "category"), ["image", "category"])
    return rounded(pixels.error_summary(rows, ["category"]))


@query
def colour_error_per_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """21 colours of each map; a pixel's error is the mean over its channels."""
    maps = embedding_maps(spark, sf_dir)
    at = lambda c, k: F.element_at(c, (F.col("i") * 3 + k).cast("int"))
    px = maps.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(20)))).select(
        "image", F.element_at("valid", F.col("i") + 1).alias("valid"), *[at(c, k).alias(f"{c}{k}") for c in ("gt", "pred") for k in (1, 2, 3)]
    )
    return rounded(pixels.masked_errors(px, ["image"], [(f"gt{k}", f"pred{k}") for k in (1, 2, 3)]))


@query
def albedo_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro and micro errors with structural similarity; the learnt distance is null without a model."""
    rows = pixels.masked_errors(_pixels(spark, sf_dir, 0.0, "category"), ["image", "category"])
    maps = embedding_maps(spark, sf_dir)
    rows = rows.join(images.ssim(maps, ["image"], SIDE, SIDE), "image").join(images.perceptual_distance(maps, ["image"]), "image")
    return rounded(pixels.error_summary(rows, ["category"]))


# depth


SETTINGS = DepthSettings(width=SIDE, height=SIDE)


def _depth(spark, sf_dir, *more, full=False, settings=SETTINGS):
    rows = images.depth_metrics(embedding_maps(spark, sf_dir, 1.0), ["image", *more], settings, full)
    return rows.filter("valid_pixels > 0").drop("error")


@query
def depth_affine_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_depth(spark, sf_dir).drop("mask_excluded", "rms", "mean_oriented"))


@query
def depth_polarity_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_depth(spark, sf_dir).select("image", "polarity", F.col("rho").alias("score"), "mean_oriented"))


@query
def depth_polarity_forced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions taken as near = white, whatever correlates better."""
    rows = _depth(spark, sf_dir, settings=DepthSettings(width=SIDE, height=SIDE, polarity="near_white"))
    return rounded(rows.select("image", "polarity", "rho", "mean_oriented", "absrel"))


@query
def depth_category_scene_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _depth(spark, sf_dir, "category", "scene").select("image", "category", "scene", "valid_pixels", *(c for c in ("absrel", "rmse", "mae", "delta1", "log10", "rho")))
    out = pixels.depth_summary(rows.withColumn("mask_used", F.col("valid_pixels") < SIDE * SIDE), [], ["category"], ["category", "scene"])
    return rounded(out.drop("valid_pixels_mean"))


@query
def depth_full_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All means of a depth evaluation, by category and in all."""
    rows = _depth(spark, sf_dir, "category", full=True)
    return rounded(pixels.depth_summary(rows.withColumn("mask_used", F.col("mask_excluded") > 0), [], ["category"]))


@query
def depth_too_few_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images whose mask leaves fewer than two pixels."""
    maps = embedding_maps(spark, sf_dir, 1.0).withColumn("valid", F.transform("valid", lambda v, i: v & (i < F.col("image") % 5)))
    return images.depth_metrics(maps, ["image"], SETTINGS).select("image", "valid_pixels", "error")


@query
def spearman_average_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda c: F.transform(c, lambda v: F.round(v, 1))
    maps = embedding_maps(spark, sf_dir).select("image", one("gt").alias("gt"), one("pred").alias("pred"))
    return rounded(images.spearman(maps, ["image"]))


@query
def kendall_tau_b_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda c: F.transform(c, lambda v: F.round(v, 1))
    maps = embedding_maps(spark, sf_dir).withColumns({"gt": one("gt"), "pred": one("pred")})
    return rounded(images.kendall(maps, ["image"]))


@query
def kendall_tau_b_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tau-b within the mask, of values some of which are not finite."""
    odd = lambda c: F.transform(c, lambda v: F.when(v > 0.2, float("nan")).otherwise(F.round(v, 1)))
    maps = embedding_maps(spark, sf_dir).withColumns({"gt": odd("gt"), "pred": odd("pred")})
    return rounded(images.kendall(maps, ["image"], valid="valid"))


@query
def kendall_sampled_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tau-b of 20 of each map's masked pixels, those of the smallest seeded hash."""
    return rounded(images.kendall(embedding_maps(spark, sf_dir), ["image"], max_pixels=20, valid="valid"))


@query
def kendall_random_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement over random pairs, of maps that agree or disagree in all pairs."""
    maps = embedding_maps(spark, sf_dir).withColumn("pred", F.transform("gt", lambda v: F.when(F.col("image") % 2 == 0, v * 3).otherwise(-v)))
    return rounded(images.sampled_kendall(maps, "image", 500, valid="valid"))


@query
def boundary_f1_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(images.boundary_f1(embedding_maps(spark, sf_dir, 1.0), ["image"], SIDE, SIDE))


@query
def ssim_8x8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(images.ssim(embedding_maps(spark, sf_dir), ["image"], SIDE, SIDE))


@query
def masked_ssim_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of maps of three colours within the mask's box; null where that is smaller than a window."""
    colours = lambda c: F.flatten(F.transform(c, lambda v: F.array(v, v / 2 + 0.3, 1 - v)))
    maps = embedding_maps(spark, sf_dir).withColumns({"gt": colours("gt"), "pred": colours("pred")})
    return rounded(images.masked_ssim(maps, ["image"], SIDE, SIDE, channels=3))


@query
def unit_scale_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("image"), (F.col("l_quantity") * F.when(F.col("l_suppkey") % 2 == 0, 10.0).otherwise(0.1)).alias("depth"))
    return rounded(pixels.unit_scale(li, ["image"]))


# normals


def _angles(spark, sf_dir, *more, **options):
    """21 encoded normals from each map, against the next one's."""
    encoded = lambda c: F.transform(F.slice(c, 1, 63), lambda v: v + 0.5)
    maps = embedding_maps(spark, sf_dir).withColumns({"gt": encoded("gt"), "pred": encoded("pred")})
    return images.angular_metrics(maps, ["image", *more], **options)


@query
def normal_angular_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_angles(spark, sf_dir))


@query
def normal_front_facing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only pixels whose ground truth faces the camera."""
    return rounded(_angles(spark, sf_dir, front_only=True).select("image", "valid_pixels", "mean_angle", "acc_30"))


@query
def normal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pixels.angular_summary(_angles(spark, sf_dir, "category"), ["category"]))


# metalness, roughness


@query
def metallic_weighted_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pixels.metallic_errors(lineitem_pixels(spark, sf_dir), ["image"], min_weight=5.0))


@query
def metric_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each metalness metric is for, and its mean over all images."""
    rows = pixels.metallic_errors(lineitem_pixels(spark, sf_dir), ["image"], min_weight=5.0)
    return rounded(settings.metric_groups(rows)).withColumn("noted", F.col("note").isNotNull()).drop("note")


@query
def metallic_split_lighting_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pixels.metallic_errors(lineitem_pixels(spark, sf_dir), ["image"], min_weight=5.0)
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("image"),
        F.concat_ws("/", F.when(F.col("p_size") <= 25, "mainaxis").otherwise("stresstest"), F.concat(F.lit("room_L"), (F.col("p_size") % 8).cast("string"), F.lit("_a")), "p_name").alias("path")
    )
    part = part.withColumn("split", P.split_of(F.col("path"))).withColumn("lighting", P.lighting_of(F.col("path"), F.col("split")))
    rows = rows.join(part.select("image", "split", "lighting"), "image")
    groups = spark.createDataFrame([(None, None), ("mainaxis", None), ("stresstest", None), *[("stresstest", f"L{i}") for i in range(6)], ("stresstest", "unknown")], "split string, lighting string")
    return rounded(pixels.metallic_summary(rows, groups, [], ["split"], ["split", "lighting"]))


@query
def roughness_summary_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), "l_orderkey")
    px = li.select(F.col("l_orderkey").alias("image"), "o_orderstatus", (F.col("l_quantity") / 50).alias("gt"), (F.col("l_discount") * 10).alias("pred"), (F.col("l_tax") > 0.02).alias("valid"))
    rows = pixels.masked_errors(px, ["image", "o_orderstatus"]).filter("valid_pixels > 0")
    rows = rows.withColumn("split", F.when(F.col("o_orderstatus") == "F", "mainaxis").when(F.col("o_orderstatus") == "O", "stresstest").otherwise("unknown"))
    groups = spark.createDataFrame([("mainaxis",), ("stresstest",)], "split string")
    return rounded(pixels.macro_summary(rows, ["split"], groups, ("mae", "rmse", "psnr")))


@query
def roughness_summary_with_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, median and deviation of five metrics by split, similarity within the mask's box."""
    maps = embedding_maps(spark, sf_dir)
    rows = pixels.masked_errors(_pixels(spark, sf_dir), ["image"]).join(images.masked_ssim(maps, ["image"], SIDE, SIDE), "image").join(images.perceptual_distance(maps, ["image"]), "image")
    rows = rows.withColumn("split", F.when(F.col("image") % 3 == 0, "mainaxis").when(F.col("image") % 3 == 1, "stresstest").otherwise("unknown"))
    groups = spark.createDataFrame([("mainaxis",), ("stresstest",)], "split string")
    return rounded(pixels.macro_summary(rows, ["split"], groups))


# colour and lighting


@query
def srgb_linear_luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """21 colours of each vector."""
    at = F.explode(F.sequence(F.lit(0), F.lit(20))).alias("pos")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), "embedding", at)
    e = e.select("image", "pos", *[(F.element_at("embedding", F.col("pos") * 3 + i).cast("double") + 0.55).alias(c) for i, c in ((1, "r"), (2, "g"), (3, "b"))])
    lin = {c: N.srgb_to_linear(F.col(c)) for c in "rgb"}
    y = N.luma(lin["r"], lin["g"], lin["b"])
    return rounded(e.select("image", "pos", lin["r"].alias("r_lin"), N.luma(F.col("r"), F.col("g"), F.col("b")).alias("y_srgb"), y.alias("y_lin"), N.linear_to_srgb(y).alias("y_back")))


def _lighting(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 40).alias("scene"), (F.col("l_quantity") / 50).alias("y_srgb"))
    return pixels.lighting_statistics(li.withColumn("y_lin", N.srgb_to_linear(F.col("y_srgb"))), ["scene"])


@query
def lighting_histogram_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_lighting(spark, sf_dir))


@query
def lighting_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("scene"), (F.col("l_discount") * F.col("l_quantity") / 5).alias("y_srgb"))
    s = pixels.lighting_statistics(li.withColumn("y_lin", N.srgb_to_linear(F.col("y_srgb"))), ["scene"])
    return s.select(
        "scene", N.brightness(F.col("mean_luma_srgb")).alias("brightness_level"), N.illumination(F.col("mean_luminance")).alias("illumination_level"), N.dynamic_range(F.col("stops")).alias("dynamic_range_level"),
        N.ratio_level(F.col("highlight_ratio"), 0.01, 0.05).alias("highlight_strength"), N.ratio_level(F.col("dark_ratio"), 0.10, 0.30).alias("dark_region_ratio_level"),
    )


@query
def region_component_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of equal sign, filled with the mean of a byte map."""
    e = table(spark, sf_dir, "embeddings")
    maps = e.select(
        F.col("vec_id").alias("image"), F.transform("embedding", lambda v: F.floor((v.cast("double") + 0.6) * 200).cast("int")).alias("value"),
        F.transform("embedding", lambda v: (v > 0.05).cast("int") + (v > -0.1).cast("int")).alias("segment")
    )
    filled = images.fill_regions(maps, ["image"], SIDE, SIDE)
    return filled.select("image", F.posexplode("filled").alias("pos", "filled"))


@query
def region_fill_across_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mosaics of 4 x 4 maps as tiles of one image, whose regions cross their edges."""
    n = F.col("vec_id")
    values = F.transform("embedding", lambda v: F.floor((v.cast("double") + 0.6) * 200).cast("int"))
    segments = F.transform("embedding", lambda v: (v > 0.05).cast("int") + (v > -0.1).cast("int"))
    place = [F.expr("vec_id div 16").alias("image"), F.expr("vec_id % 16 div 4").cast("int").alias("ty"), (n % 4).cast("int").alias("tx"), F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width")]
    maps = table(spark, sf_dir, "embeddings").select(*place, values.alias("value"), segments.alias("segment"))
    filled = tiles.fill_regions(maps, ["image"])
    return filled.select("image", "ty", "tx", F.posexplode("filled").alias("pos", "filled"))


# paths and matching


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"^https?://|[?#].*$", "").alias("path"))


@query
def match_key_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return _pages(spark, sf_dir).select(
        "page_id", P.match_key(p, "5").alias("key"), P.drop_part(p, "en").alias("without_en"), P.category(p).alias("category"), P.scene(p).alias("scene"),
        F.coalesce(P.strip_suffix(p, [".html", "/"]), F.lit("-")).alias("stripped"), P.mime_type(p).alias("mime"),
    )


def _doc_files(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("_im.png")))
    return d.withColumn("path", path).withColumn("key", P.match_key(F.col("path"), "_im"))


@query
def pair_inner_left_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt = _doc_files(spark, sf_dir).select("key", "doc_id", F.col("path").alias("gt_path"))
    labels = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    pred = labels.select(F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), F.col("doc_id").cast("string"))).alias("key"), "quality")
    mask = pred.join(
        labels.filter("toxic = 1").select(F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), F.col("doc_id").cast("string"))).alias("key")), "key", "left_semi"
    ).select("key", F.concat("key", F.lit("_mask.png")).alias("mask_path"))
    return matching.match(gt, pred, ["key"], mask)


@query
def missing_and_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' customers against all customers' keys moved by seven: some have no partner on either side."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    have = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 7).alias("key"))
    return matching.match_report(orders, have, ["key"])


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props")


@query
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.keep_first(_events(spark, sf_dir), ["user_id", "event_type"], "event_id")


@query
def dedupe_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.keep_last(_events(spark, sf_dir), ["user_id", "event_type"], "event_id")


@query
def dedupe_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.keep_preferred(_events(spark, sf_dir), ["user_id"], "event_type", ["purchase", "signup"], "event_id")


@query
def coalesce_candidate_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's earliest candidate folder that a supplier owns."""
    pages = _pages(spark, sf_dir).withColumn("candidates", P.candidate_paths(F.concat(F.col("path"), F.lit("/S"), (F.col("page_id") % 150).cast("string")), ["en", "fr"]))
    files = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("path"), "s_suppkey")
    out = matching.first_existing(pages.select("page_id", "candidates"), "page_id", "candidates", files)
    return out.select("page_id", F.size("candidates").alias("n_candidates"), "path", "s_suppkey", "place")


@query
def derived_key_two_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as predictions that need a customer of the lower half and a nation of an even key."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat_ws(
            "/", F.lit("s"), F.concat(F.lit("r"), (F.col("o_custkey") % 30).cast("string")), F.lit("a"), F.lit("b"), F.lit("Image"),
            F.concat(F.lit("cam"), F.col("o_custkey").cast("string")), F.lit("Image_1.png")
        ).alias("pred_path"),
        "o_custkey"
    )
    preds = orders.withColumn("gt_path", P.gt_path(F.col("pred_path"))).withColumn("mask_path", P.mask_path(F.col("gt_path")))
    have = table(spark, sf_dir, "customer").select(
        F.concat_ws(
            "/", F.lit("s"), F.concat(F.lit("r"), (F.col("c_custkey") % 30).cast("string")), F.lit("a/b/Metallic"),
            F.concat(F.lit("cam"), F.col("c_custkey").cast("string")), F.lit("Metallic_0001.png")
        ).alias("gt_path"),
        "c_acctbal", "c_nationkey"
    )
    gts, masks = have.filter("c_acctbal > 0").select("gt_path"), have.filter("c_nationkey % 2 = 0").select(P.mask_path(F.col("gt_path")).alias("mask_path"))
    return matching.two_lookups(preds, gts, masks, "gt_path", "mask_path").groupBy("status").agg(F.count("*").alias("n"), F.min("pred_path").alias("first_path"))


@query
def category_contains_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return d.filter(matching.contains_any("source", "src1, 7"))


@query
def topk_images_per_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return matching.top_per_group(c, ["conv_id"], 2, "turn", "role").select("conv_id", "turn", "role", "place")


@query
def limit_after_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return matching.limit_sorted(matching.match(d, table(spark, sf_dir, "labels").select("doc_id", "quality"), ["doc_id"]), 50, "source", "doc_id")


# records and audits


@query
def json_extract_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    k = F.col("event_id") % 5
    text = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("Answer: "), "props", F.lit(" done"))).when(k == 2, F.lit("no object here")).when(k == 3, F.concat("props", F.lit(" y "), "props")).otherwise("")
    out = e.select("event_id", X.extract_json(text).alias("r"))
    return out.select("event_id", F.get_json_object("r.json", "$.k").cast("long").alias("k"), "r.error")


@query
def analysis_defaulting(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    k = F.col("event_id") % 4
    name = F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string"))
    text = F.when(k == 0, "{}").when(
        k == 1, F.concat(F.lit('{"scene_summary": "'), "event_type", F.lit('", "albedo_material_notes": "one"}'))
    ).when(k == 2, '{"albedo_material_notes": ["a", "b"], "albedo_lighting_notes": [], "per_view": "bad"}').otherwise(
        F.concat(F.lit('{"albedo_prompt_suffix": "s", "per_view": [{"image_name": "v1", "albedo_hint": "x"}, {"image_name": "v1", "albedo_hint": "'), "event_type", F.lit('"}]}'))
    )
    fields = records.with_defaults(F.col("t"))
    out = e.select("event_id", name.alias("image"), text.alias("t")).withColumns(fields)
    return out.select(
        "event_id", "scene_summary", F.array_join("material_notes", "|").alias("material_notes"), F.size("lighting_notes").alias("n_lighting"), "prompt_suffix",
        records.hint_of(F.col("per_view"), F.col("image")).alias("hint")
    )


@query
def validate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_size")
    said = lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    member = lambda key, value, cond: F.when(cond, F.concat(F.lit(f'"{key}": '), value))
    whole = lambda *members: F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*members)), ", "), F.lit("}"))
    number = F.col("p_size").cast("string")
    properties = whole(
        member("albedo", said(F.col("p_brand")), k % 3 != 0), member("roughness", F.when(k % 2 == 0, number).when(k % 4 == 1, F.lit('"0.5"')).otherwise("null"), k % 13 != 0),
        member("metallic", F.when(k % 4 == 0, "true").when(k % 4 == 1, F.lit("0.25")).otherwise(number), F.lit(True)),
    )
    # properties of the record itself count for nothing
    record = whole(
        member("sample_id", said(F.col("p_partkey")), k % 7 != 0), member("image_path", said(F.col("p_name")), k % 5 != 0),
        member("physical_properties", properties, k % 11 != 0), member("albedo", F.lit('"x"'), F.lit(True))
    )
    return p.select("p_partkey", F.array_join(records.record_errors(record), "; ").alias("errors"))


@query
def audit_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    votes = c.select(
        "conv_id",
        F.explode(
            F.array(
                F.struct(F.lit("scene_category").alias("field"), F.col("role").alias("value")),
                F.struct(F.lit("confidence").alias("field"), (F.length("text") % 2).cast("string").alias("value")),
                F.struct(F.lit("issues").alias("field"), F.lit("none").alias("value"))
            )
        ).alias("v")
    ).select("conv_id", "v.field", "v.value")
    return records.disagreement(votes, ["conv_id"], "field", "value")


@query
def programmatic_preserve_and_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("scene"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("brightness_level"),
        F.when(F.col("doc_id") % 3 == 0, "kept").alias("scene_category"), F.when(F.col("doc_id") % 5 == 0, 0.5).alias("confidence")
    )
    merged = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("scene"), F.when(F.col("quality") == 1, "high").alias("brightness_level"))
    out = records.complete(records.preserve(d, merged, ["scene"], ["brightness_level"]), ["brightness_level", "scene_category", "confidence", "issues"])
    return out.select("scene", "brightness_level", "scene_category", "confidence", F.size("issues").alias("n_issues"))


# manifests


@query
def manifest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _events(spark, sf_dir).select("event_id", F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("user_id"), "event_type", "value")
    return manifest.upsert(log, ["user_id", "event_type"], "event_id")


@query
def shard_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return manifest.shard(d, 4, "source", "doc_id").select("doc_id", "position", "part", "suffix")


@query
def pending_by_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key's latest run against the one of the first half of the log."""
    e = _events(spark, sf_dir)
    last = lambda rows: matching.keep_last(rows, ["user_id", "event_type"], "event_id").select("user_id", "event_type", F.sha2("props", 256).alias("signature"))
    half = e.agg(F.expr("max(event_id) div 2").alias("half"))
    earlier = e.join(F.broadcast(half), e["event_id"] <= F.col("half")).drop("half")  # one row
    state = manifest.skip_state(last(e), last(earlier), ["user_id", "event_type"], "signature")
    return state.groupBy("event_type", "state").agg(F.count("*").alias("n"), F.min("signature").alias("first_signature"))


def _messages(spark, sf_dir):
    k = F.col("event_id") % 8
    said = (
        F.when(k == 0, "Error: {'code': 'moderation_blocked', 'x': 1}").when(k == 1, 'bad {"code": "rate_limit_exceeded"}').when(k == 2, "HTTP 404 Not Found").when(k == 3, "HTTP 500: {'status_code': 500}")
        .when(k == 4, "request timed out").when(k == 5, "rejected by the safety system").when(k == 6, F.concat(F.lit("plain "), F.col("event_type"))).otherwise("Connection reset by peer")
    )
    return _events(spark, sf_dir).select("event_id", F.col("event_type").alias("kind"), said.alias("message"))


@query
def error_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("message")
    return _messages(spark, sf_dir).select(
        "event_id", X.error_code(m, F.col("kind")).alias("code"), X.skippable(m).alias("skip"), X.retryable(m).alias("retry"), X.client_error(m).alias("client_error")
    )


@query
def retry_backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = _messages(spark, sf_dir).filter(X.retryable(F.col("message"))).select("event_id")
    two = manifest.retry_schedule(failed, 5).withColumn("kind", F.lit("exponential")).unionByName(manifest.retry_schedule(failed, 3, "linear", 3.0).withColumn("kind", F.lit("linear")))
    return two.groupBy("kind", "attempt").agg(F.count("*").alias("n"), F.sum("wait_seconds").alias("wait_seconds"))


@query
def progress_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.progress(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "source", ["doc_id"])


@query
def variant_cross_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    variants = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return matching.with_variants(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), variants).groupBy("r_name", "p_brand").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("keys"))


# prompts, sizes, signatures


@query
def prompt_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    notes = F.array_compact(F.array(F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.when(F.col("doc_id") % 3 == 0, F.lit("third"))))
    return d.select("doc_id", X.clamp(F.col("text"), 120).alias("clamped"), X.prompt("Notes:", notes, F.when(F.col("doc_id") % 5 == 0, "end").otherwise("")).alias("prompt"))


@query
def size_parse_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size")
    side = ((F.col("p_partkey") % 40 + 1) * 64).cast("string")
    text = F.when(k % 6 == 0, "adaptive").when(k % 6 == 1, "big").otherwise(F.concat(side, F.when(k % 2 == 0, "*").otherwise(" X "), (k * 48).cast("string")))
    w, h = X.parse_size(text)
    return table(spark, sf_dir, "part").select("p_partkey", w.cast("long").alias("width"), h.cast("long").alias("height")).withColumn("error", X.size_error(F.col("width"), F.col("height")))


@query
def data_uri_and_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("sha256"), F.regexp_replace(X.data_uri(F.lit("text/plain"), F.col("url").cast("binary")), r"[\r\n]", "").alias("uri"))


@query
def split_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits may overlap: each membership is a row."""
    d = table(spark, sf_dir, "documents").select(
        "source",
        F.array_compact(F.array(F.when(F.col("doc_id") % 10 < 8, "train"), F.when(F.col("doc_id") % 10 >= 7, "val"), F.when(F.col("doc_id") % 4 == 0, "test"))).alias("splits")
    )
    return d.select("source", F.explode("splits").alias("split")).groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("source").alias("n_sources"))


@query
def letterbox_box_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.geometry import letterbox_box, scaled_box

    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 37 + 100).alias("w"), (F.col("p_partkey") % 900 + 120).alias("h"))
    p = p.withColumns(letterbox_box(F.col("w"), F.col("h"), 1536, 1024))
    return p.withColumns(scaled_box("left", "top", "right", "bottom", 1536, 1024, F.col("w") * 2, F.col("h") * 2)).drop("w", "h")


QUERIES |= file_queries.QUERIES | more_queries.QUERIES
