import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake.functions import numeric as N
from rasterlake.functions import paths as P
from rasterlake.functions import texts as X
from rasterlake.operators.settings import DepthSettings
from rasterlake.operators import images, manifest, matching, pixels, records


def values(spark, column, *rows, schema="p string"):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    return [r[0] for r in df.select(column).collect()]


def test_paths(spark):
    p = F.col("p")
    assert values(spark, P.match_key(p, "_im"), "a/b/1_im.png", "1_im.x.png", "2.png") == ["a/b/1", "1_im.x", "2"]
    assert values(spark, P.strip_suffix(p, ["_a.png", ".png"]), "x_a.png", "x.png", "x.jpg") == ["x", "x", None]
    assert values(spark, P.category(p), "a/b/c", "a/b") == ["a", ""]
    assert values(spark, P.scene(p), "a/b/c", "a/b") == ["b", "a"]
    assert values(spark, P.split_of(p), "x/MainAxis_1/y", "stresstest/z", "q") == ["mainaxis", "stresstest", "unknown"]
    assert values(spark, P.lighting_of(p, F.lit("stresstest")), "a/x_L3_b", "L9/L0", "q") == ["L3", "L0", "unknown"]
    assert values(
        spark, P.gt_path(p), "s/v/a/b/c/Image/cam/x.png", "s/r/t/u/Image/cam/metallic/Image_1_metallic.png", "short/x.png"
    ) == ["s/v/a/b/c/Metallic/cam/Metallic_0001.png", "s/r/t/u/Metallic/cam/Metallic_0001.png", None]
    assert values(spark, P.mask_path(p), "s/Metallic/cam/Metallic_0001.png") == ["s/MetallicEvalMask/cam/MetallicEvalMask_0001.png"]
    assert values(
        spark, P.is_metallic_prediction(p), "v/Image/c/Image_1.png", "v/Image/c/Image_1_depth.png", "v/Image/c/metallic/Image_1_metallic.png", "v/Image/c/metallic/x.png",
        "v/Image/c/a.txt"
    ) == [True, False, True, False, False]
    assert values(spark, P.candidate_paths(p, ["ds"]), "root/ds/a/b.png") == [["root/ds/a/b.png", "a/b.png", "ds/a/b.png", "b.png"]]
    assert values(spark, P.swap_folder(p, "Image", "ObjectSegmentation"), "image/x/Image/a.png") == ["image/x/ObjectSegmentation/a.png"]
    assert values(spark, P.paired_segment(p), "a/1_im.png") == ["a/1_seg.png"]
    assert values(spark, P.normalise_suffix(p), " Seg ", "none", "_x") == ["_seg", "", "_x"]
    assert values(spark, P.candidate_names(p, ["", "m"], ["", "_s"], [".png"]), "a") == [["a.png", "a_s.png", "m/a.png", "m/a_s.png"]]
    assert values(spark, P.output_path("out", p, "_d.png"), "a/b.png") == ["out/a/b_d.png"]
    assert values(spark, P.known_part(p, ["x"]), "a/x/b", "a") == ["x", None]


def test_texts(spark):
    p = F.col("p")
    assert values(spark, X.clamp(p, 10), "a  b\n c", "abcdefg hijklm", "abcdef, hijklm") == ["a b c", "abcdefg...", "abcdef..."]
    assert values(spark, X.size_alias(p, "1x1", ["2x2"]), None, "2K", "2x2") == ["1x1", "1x1", "2x2"]
    with pytest.raises(Exception, match="unsupported size"):
        values(spark, X.size_alias(p, "1x1", ["2x2"]), "9")
    assert values(spark, X.extract_json(p), '{"a": 1}', 'x {"a": 1} y', '[{"a": 1}]', "{a}", "no", "", None) == [
        ('{"a": 1}', None), ('{"a": 1}', None), ('{"a": 1}', None),
        (None, "json_parse_error: Expecting property name enclosed in double quotes: line 1 column 2 (char 1)"), (None, "json_not_found"), (None, "empty_response"),
        (None, "empty_response")
    ]
    assert values(spark, X.without_fence(p), "```json\n{}\n```", "{}") == ["{}", "{}"]
    assert values(spark, X.http_summary(F.lit(404), F.lit("NF"), p, 3), "abcd") == ["HTTP 404 NF: abc...<truncated>"]
    assert values(spark, X.append_within(p, F.lit("xx"), 5), "ab", "abcd") == ["ab xx", "abcd"]
    assert values(spark, X.seed_of(p, 7), "a") == [(0xE8B7BE43 + 7) & 0xFFFFFFFF]
    assert values(spark, X.backoff(p.cast("int")), "0", "3", "9") == [5, 40, 60]


def test_numbers(spark):
    df = spark.createDataFrame([(0.0,), (1e-13,), (0.01,), (float("nan"),), (None,)], "p double")
    out = [r[0] for r in df.select(N.psnr(F.col("p"))).collect()]
    assert out[0] == out[1] == float("inf") and out[2] == pytest.approx(20) and out[4] is None
    assert [r[0] for r in df.select(N.finite(F.col("p"))).collect()][3] is None
    assert df.select(N.safe_div(F.lit(1.0), F.col("p"))).first()[0] is None
    back = df.filter("p >= 0 and not isnan(p)").select(N.linear_to_srgb(N.srgb_to_linear(F.col("p"))), "p").collect()
    assert all(a == pytest.approx(b, abs=1e-9) for a, b in back)


def test_matching_orders_and_reports(spark):
    files = spark.createDataFrame([("k", "exr", "1"), ("k", "dat", "2"), ("k", "dat", "3"), ("z", "exr", "4")], "key string, kind string, path string")
    pick = lambda df: sorted((r.key, r.path) for r in df.collect())
    assert pick(matching.keep_first(files, ["key"], "path")) == [("k", "1"), ("z", "4")]
    assert pick(matching.keep_last(files, ["key"], "path")) == [("k", "3"), ("z", "4")]
    assert pick(matching.keep_preferred(files, ["key"], "kind", ["dat", "exr"], "path")) == [("k", "2"), ("z", "4")]
    found, missing = matching.include_list(files, "key", ["z", "q"])
    assert [(r.key, r.place) for r in found.collect()] == [("z", 0)] and [r.key for r in missing.collect()] == ["q"]
    with pytest.raises(Exception, match="unknown variant"):
        matching.variant_of(files, spark.createDataFrame([("k", 1)], "key string, v int"), "key").collect()
    assert matching.unmatched(files, files.filter("key = 'k'"), ["key"]).count() == 1
    assert matching.sampled(files, 2, 1, "path").count() == 2


def test_manifest_operators(spark):
    rows = spark.createDataFrame([(f"{i:03d}",) for i in range(37)], "k string")
    out = sorted((r.position, r.k, r.part, r.suffix) for r in manifest.shard(rows, 3, "k").collect())
    assert out == [(i, f"{i:03d}", i % 3, f".part{i % 3 + 1}of3") for i in range(37)]
    assert manifest.shard(rows, 1, "k").filter("suffix = ''").count() == 37
    with pytest.raises(ValueError):
        manifest.shard(rows, 0, "k")
    prev = spark.createDataFrame([("000", "s", "f"), ("001", "old", "f"), ("002", "s", "g")], "k string, sig string, fp string")
    now = rows.filter("k < '004'").withColumns({"sig": F.lit("s"), "fp": F.lit("f")})
    assert [r.state for r in manifest.skip_state(now, prev, ["k"], "sig", "fp").orderBy("k").collect()] == ["current", "changed", "changed", "new"]
    assert manifest.pending(now, prev, ["k"], F.col("sig") == "s").count() == 2
    assert manifest.pending(now, prev, ["k"], overwrite=True).count() == 4


def test_records(spark):
    views = F.from_json(
        F.lit('[{"image_name": "a", "albedo_hint": "1"}, {"image_name": "a", "albedo_hint": "2"}, {"image_name": "", "albedo_hint": "3"}]'),
        "array<struct<image_name:string,albedo_hint:string>>"
    )
    assert values(spark, records.hint_of(views, F.col("p")), "a", "b", "") == ["2", "", ""]
    merged = spark.createDataFrame([(1, "high", ["x"])], "scene int, brightness_level string, disagreement_fields array<string>")
    assert '"high"' in merged.select(records.review_context(merged, ["brightness_level"], "disagreement_fields")).first()[0]


def test_missing_metric_model_gives_nulls(spark):
    assert images.perceptual_distance(spark.createDataFrame([(1,)], "image int"), ["image"]).first()["lpips"] is None


def test_constant_prediction_and_empty_mask(spark):
    px = spark.createDataFrame([(1, float(g), 2.0, True) for g in (1, 2, 3)] + [(2, 1.0, 1.0, False)], "image int, gt double, pred double, valid boolean")
    rows = {r.image: r for r in pixels.masked_errors(px, ["image"]).collect()}
    assert rows[2].valid_pixels == 0 and rows[2].mae is None and rows[1].mae == pytest.approx(2 / 3)
    maps = spark.createDataFrame(
        [(1, [1.0, 2.0, 3.0], [2.0, 2.0, 2.0], [True] * 3), (2, [1.0], [1.0], [False]), (3, [1.0, 2.0], [float("nan"), 1.0], [True, True])],
        "image int, gt array<double>, pred array<double>, valid array<boolean>"
    )
    out = {r.image: r for r in images.depth_metrics(maps, ["image"], DepthSettings(width=3, height=1)).collect()}
    assert (out[1].polarity, out[1].scale, out[1]["shift"], out[1].error) == ("far_white", 0.0, 2.0, None)
    assert out[2].error and out[3].error and out[2].valid_pixels == 0 and out[3].valid_pixels == 1
    near = images.depth_metrics(maps, ["image"], DepthSettings(polarity="near_white")).filter("image = 1").first()
    assert (near.scale, near["shift"], near.mae) == (1.0, 1.0, pytest.approx(2 / 3))


def test_taus_are_masked_before_they_are_sampled(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=400)
    y = np.where(np.arange(400) % 2, x, -x)
    y[1] = np.nan
    df = spark.createDataFrame([("a", x.tolist(), y.tolist(), (np.arange(400) % 2 == 1).tolist())], "image string, gt array<double>, pred array<double>, valid array<boolean>")
    for most in (20, 150, 1000):
        assert images.kendall(df, ["image"], most, valid="valid").first().tau == 1.0
    assert images.sampled_kendall(df, "image", 300, valid="valid").first().tau == 1.0
    assert -0.2 < images.kendall(df, ["image"], 300).first().tau < 0.2


def test_answers_and_urls(spark):
    p = F.col("p")
    shapes = [
        '{"output_text": "a"}', '{"output": [{"content": [{"text": "b"}, {"text": ""}, {"text": "c"}]}, {}]}', '{"choices": [{"message": {"content": "d"}}]}',
        '{"choices": [{"message": {"content": [{"type": "text", "text": "e"}]}}]}', '{"x": 1}'
    ]
    assert values(spark, X.answer_text(p), *shapes) == ["a", "b\nc", "d", "e", '{"x": 1}']
    assert values(spark, X.image_url(p), '{"output": {"choices": [{"message": {}}, {"message": {"content": [{"text": "t"}, {"image": "u"}]}}]}}') == ["u"]
    with pytest.raises(Exception, match="no image"):
        values(spark, X.image_url(p), "{}")
    assert values(spark, records.completed_scene(p), '{"a": 1}', '{"error": "x"}', '{"error": null}', "[]", "nonsense") == [True, False, True, False, False]
    assert values(spark, records.baseline_metrics(p)["mae"], '{"mae": 0.5}', "{}") == [0.5, 0.0]


def test_sampled_tau_is_seeded_by_name(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0, 3.0], [1.0, 2.0, 3.0]), ("b", [1.0, 2.0, 3.0], [3.0, 2.0, 1.0])], "image string, gt array<double>, pred array<double>")
    assert sorted((r.image, r.tau) for r in images.sampled_kendall(df, "image", 500).collect()) == [("a", 1.0), ("b", -1.0)]


def test_settings_are_checked():
    from rasterlake.operators.settings import DepthSettings

    assert DepthSettings().thresholds == 10
    for bad in ({"width": 0}, {"mask_threshold": 2}, {"t_min": 1.0}, {"max_pixels": -1}, {"polarity": "x"}, {"resize": "x"}):
        with pytest.raises(ValueError):
            DepthSettings(**bad)


def test_retries_and_progress(spark):
    one = spark.createDataFrame([("x", "s")], "k string, g string")
    assert [r.wait_seconds for r in manifest.retry_schedule(one, 3, "fixed", 3.0).orderBy("attempt").collect()] == [3, 3, 3]
    with pytest.raises(ValueError):
        manifest.retry_schedule(one, 3, "other")
    slept, tries = [], iter([OSError("timed out"), OSError("timed out"), "done"])

    def call():
        x = next(tries)
        if isinstance(x, Exception):
            raise x
        return x

    assert manifest.with_retries(call, 5, lambda n: min(60, 5 * 2**n), lambda e: "timed out" in str(e), slept.append) == "done" and slept == [5, 10]
    with pytest.raises(KeyError):
        manifest.with_retries(lambda: {}["k"], 5, float, lambda e: isinstance(e, OSError))
    inputs = spark.createDataFrame([("a", "s"), ("b", "s"), ("c", "s")], "k string, g string")
    out = {r.g: r for r in manifest.progress(inputs, inputs.filter("k = 'a'"), "g", ["k"], inputs.filter("k <> 'c'")).collect()}
    assert (out["TOTAL"].n_done, out["s"].n_skipped, out["s"].n_remaining, out["s"].percent) == (1, 1, 1, 33.33)
