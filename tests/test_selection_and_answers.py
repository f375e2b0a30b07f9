"""Exact selection of quantiles, answers parsed strictly, stem index and keyed masks, settings over columns."""

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake.functions import kernels
from rasterlake.functions import paths as P
from rasterlake.functions import texts as X
from rasterlake.operators import images, matching, pixels, quantiles, records, settings

# quantiles


def brute(rows, keys, metric, q):
    groups = {}
    for r in rows:
        groups.setdefault(tuple(r[k] for k in keys), []).append(r[metric])
    finite = {k: [v for v in vs if v is not None and np.isfinite(v)] for k, vs in groups.items()}
    return {k: np.quantile(vs, q) for k, vs in finite.items() if vs}


@pytest.mark.parametrize(("bins", "few", "q"), [(4096, 10_000, 0.5), (4096, 10_000, 0.0), (4096, 10_000, 1.0), (8, 4, 0.95), (2, 1, 0.5)])
def test_quantiles_equal_numpy(spark, monkeypatch, bins, few, q):
    monkeypatch.setattr(quantiles, "BINS", bins)
    monkeypatch.setattr(quantiles, "FEW", few)
    rng = random.Random(bins)
    odd = [None, float("nan"), float("inf"), -float("inf"), 0.0, -0.0, 1e300, -1e300, 5e-324]
    rows = []
    for i in range(300):
        wide = rng.choice([rng.gauss(0, 1), rng.randint(0, 3), 10 ** rng.uniform(-9, 9)])
        rows.append({"g": rng.choice(["a", "b", None]), "h": i % 2, "x": float(wide) if i % 9 else rng.choice(odd[:5]), "y": rng.choice([1.0, 2.0])})
    rows += [{"g": "one", "h": 0, "x": 3.5, "y": None}, {"g": "none", "h": 0, "x": None, "y": float("nan")}, {"g": "huge", "h": 1, "x": 1e300, "y": 1.0}, {"g": "huge", "h": 1, "x": -1e300, "y": 1.0}]
    df = spark.createDataFrame([(r["g"], r["h"], r["x"], r["y"]) for r in rows], "g string, h int, x double, y double").repartition(3)
    got = quantiles.quantiles(df, {"mx": "x", "my": "y"}, ["g"], ["g", "h"], [], q=q).collect()
    for level, keys in enumerate((["g"], ["g", "h"], [])):
        found = {tuple(r[k] for k in keys): r for r in got if r["__level"] == level}
        for name, metric in (("mx", "x"), ("my", "y")):
            want = brute(rows, keys, metric, q)
            have = {k: r[name] for k, r in found.items() if r[name] is not None}
            assert have.keys() == want.keys()
            for k in want:
                assert have[k] == pytest.approx(want[k], rel=1e-9, abs=1e-9)


def test_quantiles_hold_no_group(spark, monkeypatch):
    """What is gathered is a range of at most FEW values, in a group of any size."""
    monkeypatch.setattr(quantiles, "FEW", 50)
    df = spark.range(200_000).select((F.col("id") * 7919 % 100_003).cast("double").alias("x"), F.lit("g").alias("g"))
    listed = []
    collect = F.collect_list
    monkeypatch.setattr(quantiles.F, "collect_list", lambda c: (listed.append(c), collect(c))[1])
    got = quantiles.quantiles(df, {"m": "x"}, ["g"]).first()
    values = [i * 7919 % 100_003 for i in range(200_000)]
    assert got["m"] == np.median(values) and listed == ["__v"]


def test_summaries_at_levels_and_without_rows(spark):
    rows = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("a", "y", 9.0), (None, "x", 4.0)], "g string, h string, mae double")
    out = quantiles.summarised(rows, [["g"], ["g", "h"], []], [F.count("*").alias("n")], ["mae"]).collect()
    assert sorted((str(r.g), str(r.h), r.n, r.mae_median) for r in out) == sorted(
        [("a", "None", 3, 2.0), ("None", "None", 1, 4.0), ("a", "x", 1, 1.0), ("a", "y", 2, 5.5), ("None", "x", 1, 4.0), ("None", "None", 4, 3.0)]
    )
    assert quantiles.summarised(rows.limit(0), [["g"]], [F.count("*").alias("n")], ["mae"]).count() == 0
    assert pixels.unit_scale(rows, ["g"], "mae").filter("unit_scale = 1.0").count() == 2


# samples of pixels


def test_bottom_k_is_a_mergeable_sample():
    places = np.arange(5000)
    whole = kernels.bottom_k(places, 200, 99)
    parts = np.concatenate([kernels.bottom_k(p, 200, 99) for p in np.array_split(places, 7)])
    assert np.array_equal(kernels.bottom_k(np.sort(parts), 200, 99), whole)
    assert len(set(whole.tolist())) == 200 and not np.array_equal(kernels.bottom_k(places, 200, 100), whole)
    assert len(np.unique(kernels.mixed(np.arange(1 << 16), 5))) == 1 << 16
    shares = np.histogram(whole, bins=5, range=(0, 5000))[0]
    assert shares.min() > 20


def test_no_limit_of_pixels_means_all(spark):
    maps = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 5.0] * 100, [2.0, 1.0, 3.0, 9.0] * 100)], "image int, gt array<double>, pred array<double>")
    tau = lambda n: images.kendall(maps, ["image"], max_pixels=n).first().tau
    assert tau(0) == tau(400) == tau(20_000) is not None
    assert tau(50) == tau(50) != tau(0)


def test_sampled_tau_is_one_for_every_batch(spark):
    rng = np.random.default_rng(3)
    rows = [(f"i{k}", rng.random(64).tolist(), rng.random(64).tolist(), [True] * 64) for k in range(6)]
    maps = spark.createDataFrame(rows, "image string, gt array<double>, pred array<double>, valid array<boolean>")
    few = settings.DepthSettings(width=8, height=8, max_pixels=20)
    one = {r.image: r.tau for r in images.depth_metrics(maps.coalesce(1), ["image"], few, full=True).collect()}
    assert one == {r.image: r.tau for r in images.depth_metrics(maps.repartition(6), ["image"], few, full=True).collect()}


# answers


def plain_extract(text):
    if not text:
        return None, "empty_response"
    text = text.strip()
    try:
        if isinstance(whole := json.loads(text), dict):
            return whole, None
    except ValueError:
        pass
    cut = re.search(r"\{[\s\S]*\}", text)
    if not cut:
        return None, "json_not_found"
    try:
        return json.loads(cut[0]), None
    except ValueError as e:
        return None, f"json_parse_error: {e}"


def plain_repair(text):
    text = text.strip()
    if fence := re.search(r"```(?:json)?\s*(.*?)\s*```", text, re.DOTALL | re.IGNORECASE):
        text = fence[1].strip()
    try:
        return json.loads(text), None
    except ValueError as e:
        a, b = text.find("{"), text.rfind("}")
        if 0 <= a < b:
            try:
                return json.loads(text[a : b + 1]), None
            except ValueError as inner:
                e = inner
        return None, str(e)


ANSWERS = [
    "", " ", "no", "{}", '{"a": 1}', ' {"a": [1, {"b": null}]} ', '{"a": 1} {"b": 2}', 'x {"a": 1} y', '{"a": 1}, {"b": 2}', '{"a": 1}],["', '{"a": 1},"__end_of_value__"], [{"q": 2}', '{"a": NaN}', '{"a": 1, "a": 2}', '[{"a": 1}]',
    "[1, 2]", "3", '"{}"', "{a}", "{'a': 1}", '{"a": 1', 'a": 1}', '{"a": "}"} z', "```json\n{\"a\": 1}\n```", "Sure: ```json {\"a\": 1}``` bye", "```{\"a\": 1} ```x```",
    "``` [1] ```", "```\nnot {\"a\": 2} quite\n```", '{"a": "\\u00e9 é"}',
    '{"a": 1e400}', '{"a": 123456789012345678901234567890123456789012345678901234567890}', '{"a": 01}', '{"a": "\n"}', '{"a": true}}', "{{}}", '﻿{"a": 1}', "{" * 50 + "}" * 50, '{"a":{"b":{"c":[[[1]]]}}}',
]


def test_answers_equal_plain_rules(spark):
    rng = random.Random(4)
    made = ["".join(rng.choices(["{", "}", '"a"', ":", "1", ",", " ", "```", "[", "]", "x", "\n", "json"], k=rng.randint(1, 9))) for _ in range(1500)]
    texts = ANSWERS + made
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.extract_json(F.col("t")).alias("e"), X.repaired_json(F.col("t")).alias("r")).collect()
    for row in rows:
        for got, want in ((row.e, plain_extract(row.t)), (row.r, plain_repair(row.t))):
            value = None if got.json is None else json.dumps(json.loads(got.json))
            assert (value, got.error) == (None if want[1] else json.dumps(want[0]), want[1]), row.t
    nothing = spark.createDataFrame([(None,)], "t string").select(X.extract_json(F.col("t")).alias("e"), X.repaired_json(F.col("t")).alias("r")).first()
    assert nothing.e.error == "empty_response" and nothing.r.json is None


def test_python_sees_only_what_spark_refuses(spark, monkeypatch):
    seen = []
    df = spark.createDataFrame([('{"a": 1}',), ('x {"a": 2} y',), ("none",)], "t string")
    assert [r.e.json for r in df.select(X.extract_json(F.col("t")).alias("e")).collect()] == ['{"a": 1}', '{"a": 2}', None]
    monkeypatch.setattr(
        X, "_reparsed",
        lambda c: (seen.append(c), F.struct(F.when(c.isNotNull(), F.raise_error(F.lit("sent"))).cast("string").alias("json"), F.lit(None).cast("string").alias("error")))[1]
    )
    assert df.select(X.extract_json(F.col("t")).alias("e")).collect()
    with pytest.raises(Exception, match="sent"):
        spark.createDataFrame([("{a}",)], "t string").select(X.extract_json(F.col("t")).alias("e")).collect()


def test_records_are_checked_within_their_properties(spark):
    def plain(text):
        record = json.loads(text)
        errors = [f"missing key: {k}" for k in ("sample_id", "image_path", "physical_properties") if k not in record]
        p = record.get("physical_properties", {})
        errors += [f"missing physical property: {k}" for k in ("albedo", "roughness", "metallic") if k not in p]
        return errors + [f"{k} must be numeric" for k in ("roughness", "metallic") if k in p and not isinstance(p[k], int | float)]

    props = [
        None, {}, {"albedo": "x", "roughness": 0.5, "metallic": 1}, {"roughness": "0.5", "metallic": True}, {"albedo": None, "roughness": None, "metallic": [1]},
        {"metallic": 1e30, "roughness": 123456789012345678901}
    ]
    texts = [
        json.dumps({"albedo": 1, "roughness": "x"} | ({"sample_id": "s", "image_path": None} if i % 2 else {}) | ({} if p is None else {"physical_properties": p})) for i,
        p in enumerate(props * 2 + props[:1])
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", records.record_errors(F.col("t")).alias("e")).collect()
    assert all(r.e == plain(r.t) for r in rows)
    assert len(spark.createDataFrame([("{broken",)], "t string").select(records.record_errors(F.col("t")).alias("e")).first().e) == 6


def test_names_for_no_suffix_and_types(spark):
    df = spark.createDataFrame([(t,) for t in [" None ", "BARE", "no_suffix", "noSuffix", "", None, "null", "no", "-", "_x", "Seg"]], "t string")
    assert [r[0] for r in df.select(P.normalise_suffix(F.col("t"))).collect()] == ["", "", "", "", "", "", "_null", "_no", "_-", "_x", "_seg"]
    df = spark.createDataFrame([("a.TIF",), ("a.JPG",), ("a.bmp",), ("a",)], "t string")
    assert [r[0] for r in df.select(P.mime_type(F.col("t"))).collect()] == ["application/octet-stream", "image/jpeg", "image/bmp", "application/octet-stream"]


def test_data_uris_are_one_line(spark):
    import base64

    body = bytes(range(256)) * 4
    uri = spark.createDataFrame([(body,)], "b binary").select(X.data_uri(F.lit("image/png"), F.col("b"))).first()[0]
    assert uri == "data:image/png;base64," + base64.b64encode(body).decode()


# candidates


def test_stem_index_equals_every_path_tried(spark):
    rng = random.Random(8)
    names = [f"{d}{s}{e}" for d in ("", "a/", "a/b/") for s in ("x", "x_seg", "y.v1", ".hid", "z") for e in (".png", ".jpg", "", ".PNG")]
    rows = [(i, rng.sample(names, rng.randint(0, 9)) + [None], rng.choice(names)) for i in range(80)]
    files = [(n, rng.randint(0, 2)) for n in rng.sample(names, 30)]
    have = dict(files)
    df, fs = spark.createDataFrame(rows, "k int, c array<string>, own string"), spark.createDataFrame(files, "path string, tier int")
    for never in (None, "own"):
        got = {r.k: r for r in matching.first_existing(df, "k", "c", fs, order=("tier",), never=never).collect()}
        for k, cs, own in rows:
            tries = [(have[c], i, c) for i, c in enumerate(cs) if c in have and not (never and c == own)]
            want = min(tries) if tries else (None, None, None)
            assert (got[k].tier, got[k].place, got[k].path) == want


def test_a_row_is_sent_once_for_a_stem(spark):
    df = spark.range(50).select("id", P.mask_paths(F.concat(F.lit("d/"), F.col("id").cast("string"), F.lit(".png"))).alias("c"))
    files = spark.range(50).select(F.concat(F.lit("d/"), F.col("id").cast("string"), F.lit(".webp")).alias("path"))
    plan = matching.first_existing(df, "id", "c", files)._jdf.queryExecution().optimizedPlan().toString()
    assert matching.first_existing(df, "id", "c", files).filter("path is not null").count() == 50
    assert plan.count("Generate explode") == 1
    of_stem = matching.first_existing(df, "id", "c", files.limit(0))
    assert of_stem.count() == 50


def test_masks_by_name_stem_and_key(spark):
    rows = spark.createDataFrame(
        [(1, "a/1.png", "a/1", "a/1.png"), (2, "a/2.png", "a/2", None), (3, "a/3.png", "a/3", None), (4, "a/4.png", "a/4", None), (5, "a/5.png", "a/5", "a/5.png")],
        "k int, rel string, pair string, own string"
    )
    files = spark.createDataFrame([("a/1.png",), ("a/1.bmp",), ("a/2.png",), ("a/2.jpg",), ("a/3_mask.png",), ("a/3_mask.tif",), ("a/5.png",)], "path string")
    got = {r.k: (r["mask"], r.tier) for r in matching.resolved_masks(rows, "k", "rel", "pair", files, own="own", suffix="_mask").collect()}
    assert got == {1: ("a/1.bmp", 1), 2: ("a/2.png", 0), 3: ("a/3_mask.tif", 2), 4: (None, None), 5: ("a/5.png", 2)}
    by_name = {r.k: r["mask"] for r in matching.resolved_masks(rows, "k", "rel", "pair", files, by_name=True, own="own", suffix="_mask").collect()}
    assert by_name[5] == "a/5.png"


# settings


def test_settings_of_rows_break_the_rules_that_raise(spark):
    cases = [{"width": 0}, {"t_min": 1.0}, {"t_max": 1.01}, {"polarity": "up"}, {"resize": "area"}, {"max_pixels": -1}, {"delta05": 1.0}, {"mask_threshold": 1.5}, {}]
    for case in cases:
        try:
            settings.DepthSettings(**case)
            want = []
        except ValueError as e:
            want = [str(e)]
        row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in case.items()], "id")
        assert row.select(settings.errors(settings.DepthSettings, row.columns)).first()[0] == want
    assert settings.DepthSettings().seed == 12345 and settings.DepthSettings(max_pixels=0).max_pixels == 0
    with pytest.raises(ValueError, match="suffix"):
        settings.MatchSettings(mode="name", suffix="_im")


def test_of_files_of_one_path_one_is_joined(spark):
    """Rows that meet a path cost one row each, however many files have it."""
    files = spark.range(3000).select((F.col("id") % 3).cast("string").alias("path"), (F.col("id") % 7).alias("tier"), (3000 - F.col("id")).alias("n"))
    rows = spark.range(40).select("id", F.array((F.col("id") % 4).cast("string"), F.lit("1")).alias("c"))
    found = matching.first_existing(rows, "id", "c", files, order=("tier", "n"))
    best = {p: min((i % 7, 3000 - i) for i in range(3000) if i % 3 == p) for p in range(3)}
    for r in found.collect():
        tier, n, place = min((*best[p], at) for at, p in enumerate((r.id % 4, 1)) if p in best)
        assert (r.tier, r.n, r.path) == (tier, n, str((r.id % 4, 1)[place])) and r.place == place
    joined = found._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[1]
    assert "Aggregate [path" in joined  # below the join of candidates and files


def fifty_tenths(spark):
    """Two images whose weights of metal, and of what is not, are 5 in tenths; in order their doubles add up to less."""
    values = [(image, gt, 0.3, True) for image, gt in ((1, 0.1), (2, 0.9)) for _ in range(50)]
    return spark.createDataFrame(values, "image int, gt double, pred double, valid boolean").coalesce(1)


def test_summary_counts_images_of_the_least_weight(spark):
    assert np.cumsum([0.1] * 50)[-1] < 5
    rows = pixels.metallic_errors(fifty_tenths(spark), ["image"], min_weight=5.0)
    out = pixels.metallic_summary(rows, None, []).first()
    assert (out.n_images, out.n_metal_weighted, out.n_nonmetal_weighted) == (2, 2, 2)


def test_weighted_means_of_images_of_the_least_weight(spark):
    found = {r.image: r for r in pixels.metallic_errors(fifty_tenths(spark), ["image"], min_weight=5.0).collect()}
    assert found[1].metal_mae == pytest.approx(0.2) and found[2].nonmetal_mae == pytest.approx(0.6)
    above = pixels.metallic_errors(fifty_tenths(spark), ["image"], min_weight=5.0001).filter("image = 1").first()
    assert above.metal_mae is None
