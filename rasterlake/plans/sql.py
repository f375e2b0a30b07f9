"""The registered queries in DuckDB's SQL, over the same tables."""

from __future__ import annotations

from . import file_queries, more_queries

ORACLE_SQL: dict[str, str] = {}


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"CASE WHEN isfinite({expr}) THEN round({expr}, {digits}) + 0.0 END AS {name}"


def macro(name: str, stats: str = "mean median std") -> str:
    v = f"CASE WHEN isfinite({name}) THEN {name} END"
    make = {"mean": f"avg({v})", "median": f"median({v})", "std": f"stddev_pop({v})"}
    return ", ".join(r(make[s], f"{name}_{s}") for s in stats.split())


def px(shift: float = 0.0) -> str:
    return f"""
m AS (
  SELECT a.vec_id AS image, 'c' || a.label AS category, a.vec_id % 20 AS scene, a.embedding AS g, b.embedding AS p, c.embedding AS k
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN embeddings c ON c.vec_id = a.vec_id + 2
), px AS (
  SELECT image, category, scene, i AS pos, i // 8 AS y, i % 8 AS x, g[i + 1]::DOUBLE + {shift} AS gt, p[i + 1]::DOUBLE + {shift} AS pred, k[i + 1] > 0 AS valid
  FROM m, range(64) t(i)
)"""


PSNR = "CASE WHEN mse <= 1e-12 THEN 'infinity'::DOUBLE ELSE -10 * log10(mse) END"


def errors(source: str, keys: str) -> str:
    return f"""
s AS (
  SELECT {keys}, count(*) FILTER (WHERE valid) AS valid_pixels, sum(abs(pred - gt)) FILTER (WHERE valid) AS sum_abs, sum((pred - gt) * (pred - gt)) FILTER (WHERE valid) AS sum_sq
  FROM {source} GROUP BY ALL
), e0 AS (
  SELECT *, CASE WHEN valid_pixels > 0 THEN sum_abs / valid_pixels END AS mae, CASE WHEN valid_pixels > 0 THEN sum_sq / valid_pixels END AS mse FROM s
), e AS (
  SELECT *, sqrt(mse) AS rmse, {PSNR} AS psnr FROM e0
)"""


ORACLE_SQL["masked_error_per_image"] = f"""
WITH {px()}, {errors("px", "image")}
SELECT image, valid_pixels, {", ".join(r(c, c) for c in ("sum_abs", "sum_sq", "mae", "mse", "rmse", "psnr"))} FROM e
"""

ORACLE_SQL["error_macro_micro_summary"] = f"""
WITH {px()}, {errors("px", "image, category")}, g AS (
  SELECT category, count(*) AS n_images, sum(valid_pixels)::BIGINT AS valid_total, {macro("mae")}, {macro("rmse")}, {macro("psnr", "mean")}, sum(sum_abs) AS sa,
         sum(sum_sq) / sum(valid_pixels) AS mse FROM e GROUP BY category
)
SELECT * EXCLUDE (sa, mse), {r("sa / valid_total", "mae_micro")}, {r("mse", "mse_micro")}, {r(PSNR, "psnr_micro")} FROM g
"""


def depth(keys: str, polarity: str = "") -> str:
    near = "rho < 0" if not polarity else str(polarity == "near_white")
    w = f"OVER (PARTITION BY {keys})"
    return f"""{px(1.0)}, v AS (SELECT {keys}, pos, gt, pred FROM px WHERE valid AND gt > 0
), n0 AS (SELECT *, min(pred) {w} AS lo, max(pred) {w} AS hi FROM v
), n AS (SELECT {keys}, pos, gt, CASE WHEN hi > lo THEN (pred - lo) / (hi - lo) ELSE 0.0 END AS norm FROM n0
), k AS (
  SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY gt) - 1 + (count(*) OVER (PARTITION BY {keys}, gt) - 1) / 2.0 AS rg,
         rank() OVER (PARTITION BY {keys} ORDER BY norm) - 1 + (count(*) OVER (PARTITION BY {keys}, norm) - 1) / 2.0 AS rn FROM n
), c AS (SELECT *, count(*) {w} AS cnt, var_pop(rg) {w} AS vg, var_pop(rn) {w} AS vn, covar_pop(rg, rn) {w} AS cv FROM k
), h AS (SELECT *, CASE WHEN cnt >= 2 THEN CASE WHEN sqrt(vg * vn) > 0 THEN cv / sqrt(vg * vn) ELSE 0.0 END END AS rho FROM c
), o AS (SELECT {keys}, gt, pos, CASE WHEN {near} THEN 'near_white' ELSE 'far_white' END AS polarity, CASE WHEN {near} THEN -rho ELSE rho END AS score, CASE
       WHEN {near} THEN 1 - norm ELSE norm END AS oriented FROM h
), f AS (SELECT *, CASE WHEN var_pop(oriented) {w} > 0 THEN covar_pop(oriented, gt) {w} / var_pop(oriented) {w} ELSE 0.0 END AS scale, avg(gt) {w} AS mg, avg(oriented) {w} AS mx FROM o
), a AS (SELECT *, mg - scale * mx AS shift, scale * oriented + mg - scale * mx AS aligned FROM f
), q AS (SELECT *, greatest(gt, 1e-6) AS gp, greatest(aligned, 1e-6) AS ap, abs(aligned - gt) AS err FROM a
), d AS (
  SELECT {keys}, count(*) AS valid_pixels, any_value(polarity) AS polarity, any_value(score) AS rho, any_value(scale) AS scale, any_value(shift) AS shift,
         avg(err / gp) AS absrel, sqrt(avg(err * err)) AS rmse, avg(err) AS mae,
         avg((greatest(ap / gp, gp / ap) < 1.25)::INT) AS delta1, avg((greatest(ap / gp, gp / ap) < 1.5625)::INT) AS delta2, avg((greatest(ap / gp, gp / ap) < 1.953125)::INT) AS delta3,
         avg((greatest(ap / gp, gp / ap) < sqrt(1.25))::INT) AS delta05, avg(abs(log10(ap) - log10(gp))) AS "log10"
  FROM q GROUP BY {keys}
)"""


ORACLE_SQL["depth_affine_metrics"] = f"""
WITH {depth("image")}
SELECT image, valid_pixels, polarity, {", ".join(r(f'"{c}"', f'"{c}"') for c in ("rho", "scale", "shift", "absrel", "rmse", "mae", "delta1", "delta2", "delta3", "delta05", "log10"))} FROM d
"""

ORACLE_SQL["depth_polarity_forced"] = f"""
WITH {depth("image", "near_white")}
SELECT d.image, polarity, {r("rho", "rho")}, {r("mo", "mean_oriented")}, {r("absrel", "absrel")} FROM d JOIN (SELECT image, avg(oriented) AS mo FROM o GROUP BY image) USING (image)
"""

ORACLE_SQL["depth_polarity_choice"] = f"""
WITH {depth("image")}
SELECT image, polarity, {r("any_value(score)", "score")}, {r("avg(oriented)", "mean_oriented")} FROM o GROUP BY image, polarity
"""

ORACLE_SQL["depth_category_scene_rollup"] = f"""
WITH {depth("image, category, scene")}
SELECT category, scene, count(*) AS n_images, count(*) FILTER (WHERE valid_pixels < 64) AS masks_used,
       {", ".join(r(f'avg("{c}")', f"{c}_mean") for c in ("absrel", "rmse", "mae", "delta1", "log10", "rho"))}
FROM d GROUP BY GROUPING SETS ((), (category), (category, scene))
"""

ORACLE_SQL["spearman_average_rank"] = f"""
WITH {px()}, t AS (SELECT image, round(gt, 1) AS gt, round(pred, 1) AS pred FROM px
), k AS (
  SELECT image, rank() OVER (PARTITION BY image ORDER BY gt) - 1 + (count(*) OVER (PARTITION BY image, gt) - 1) / 2.0 AS rx,
         rank() OVER (PARTITION BY image ORDER BY pred) - 1 + (count(*) OVER (PARTITION BY image, pred) - 1) / 2.0 AS ry FROM t
), c AS (SELECT image, count(*) AS n, var_pop(rx) AS vx, var_pop(ry) AS vy, covar_pop(rx, ry) AS cv FROM k GROUP BY image)
SELECT image, n, {r("CASE WHEN sqrt(vx * vy) > 0 THEN cv / sqrt(vx * vy) ELSE 0.0 END", "rho")} FROM c
"""

ORACLE_SQL["kendall_tau_b_small"] = f"""
WITH {px()}, t AS (SELECT image, pos, round(gt, 1) AS gt, round(pred, 1) AS pred FROM px
), s AS (
  SELECT a.image, sum(sign(a.gt - b.gt) * sign(a.pred - b.pred)) AS s, count(*) FILTER (WHERE a.gt <> b.gt) AS nx, count(*) FILTER (WHERE a.pred <> b.pred) AS ny
  FROM t a JOIN t b ON a.image = b.image AND a.pos < b.pos GROUP BY a.image
)
SELECT image, {r("CASE WHEN nx > 0 AND ny > 0 THEN s / sqrt(nx::DOUBLE * ny) END", "tau")} FROM s
"""

def boundary(source: str) -> str:
    """Boundary F1 by image from (image, y, x, g, p, ok) with inverse depths."""
    return f"""nb AS (
  SELECT a.image, CASE WHEN b.x > a.x THEN 'h' ELSE 'v' END AS axis, b.g / a.g AS gf, a.g / b.g AS gb, b.p / a.p AS pf, a.p / b.p AS pb
  FROM {source} a JOIN {source} b ON a.image = b.image AND ((b.x = a.x + 1 AND b.y = a.y) OR (b.y = a.y + 1 AND b.x = a.x)) AND a.ok AND b.ok
), sides AS (SELECT image, axis || 'f' AS side, gf AS g, pf AS p FROM nb UNION ALL SELECT image, axis || 'b', gb, pb FROM nb
), th AS (SELECT 1.05 + 0.2 * i / 9.0 AS t FROM range(10) q(i)
), bc AS (
  SELECT image, t, side, count(*) FILTER (WHERE g > t AND p > t) AS hit, count(*) FILTER (WHERE g > t) AS ng, count(*) FILTER (WHERE p > t) AS np FROM sides, th GROUP BY ALL
), pr AS (SELECT image, t, sum(hit / greatest(ng, 1)) / 4 AS rec, sum(hit / greatest(np, 1)) / 4 AS prec FROM bc GROUP BY image, t
), bf AS (SELECT image, sum(t * CASE WHEN rec + prec > 0 THEN 2 * rec * prec / (rec + prec) ELSE 0 END) / 11.5 AS f1 FROM pr GROUP BY image
), bn AS (SELECT image, count(*) FILTER (WHERE ok) AS n FROM {source} GROUP BY image
), edges AS (SELECT bn.image, CASE WHEN n >= 2 THEN coalesce(f1, 0) END AS boundary_f1 FROM bn LEFT JOIN bf USING (image))"""


ORACLE_SQL["boundary_f1_weighted"] = f"""
WITH {px(1.0)}, v AS (SELECT image, y, x, 1 / greatest(gt, 1e-6) AS g, 1 / greatest(pred, 1e-6) AS p, valid AND gt > 0 AS ok FROM px), {boundary("v")}
SELECT image, round(boundary_f1, 6) + 0.0 AS boundary_f1 FROM edges
"""

_SIXTEEN = ("valid_pixels", "mask_excluded", "rho", "tau", "absrel", "rmse", "rms", "mae", "delta1", "delta2", "delta3", "delta05", "log10", "boundary_f1", "scale", "shift")
ORACLE_SQL["depth_full_summary"] = f"""
WITH {depth("image, category")}, bv AS (SELECT image, pos // 8 AS y, pos % 8 AS x, 1 / greatest(gt, 1e-6) AS g, 1 / greatest(aligned, 1e-6) AS p, true AS ok FROM a), {boundary("bv")}, ks AS (
  SELECT a.image, sum(sign(a.gt - b.gt) * sign(a.oriented - b.oriented)) AS s, count(*) FILTER (WHERE a.gt <> b.gt) AS nx, count(*) FILTER (WHERE a.oriented <> b.oriented) AS ny
  FROM o a JOIN o b ON a.image = b.image AND a.pos < b.pos GROUP BY a.image
), t AS (SELECT image, CASE WHEN nx > 0 AND ny > 0 THEN s / sqrt(nx::DOUBLE * ny) END AS tau FROM ks
), me AS (SELECT image, count(*) FILTER (WHERE NOT valid) AS mask_excluded FROM px GROUP BY image
), al AS (SELECT d.*, rmse AS rms, tau, mask_excluded, boundary_f1 FROM d LEFT JOIN t USING (image) JOIN me USING (image) LEFT JOIN edges USING (image))
SELECT category, count(*) AS n_images, count(*) FILTER (WHERE mask_excluded > 0) AS masks_used, {", ".join(r(f'avg("{c}")', f"{c}_mean") for c in _SIXTEEN)} FROM al
       GROUP BY GROUPING SETS ((), (category))
"""

ORACLE_SQL["depth_too_few_pixels"] = f"""
WITH {px(1.0)}, n AS (SELECT image, count(*) FILTER (WHERE valid AND gt > 0 AND pos < image % 5) AS valid_pixels FROM px GROUP BY image)
SELECT image, valid_pixels, CASE WHEN valid_pixels < 2 THEN 'fewer than two valid pixels' END AS error FROM n
"""

ORACLE_SQL["kendall_tau_b_masked"] = f"""
WITH {px()}, t AS (SELECT image, pos, round(gt, 1) AS gt, round(pred, 1) AS pred FROM px WHERE valid AND NOT gt > 0.2 AND NOT pred > 0.2
), s AS (
  SELECT a.image, sum(sign(a.gt - b.gt) * sign(a.pred - b.pred)) AS s, count(*) FILTER (WHERE a.gt <> b.gt) AS nx, count(*) FILTER (WHERE a.pred <> b.pred) AS ny
  FROM t a JOIN t b ON a.image = b.image AND a.pos < b.pos GROUP BY a.image
)
SELECT image, {r("CASE WHEN nx > 0 AND ny > 0 THEN s / sqrt(nx::DOUBLE * ny) END", "tau")} FROM (SELECT DISTINCT image FROM px) LEFT JOIN s USING (image)
"""

_MIX = "((xor({x}, {x} >> 16)) * 73244475) % 4294967296"
ORACLE_SQL["kendall_sampled_pixels"] = f"""
WITH {px()}, t8 AS (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t FROM range(256) q(b)
), named AS (SELECT DISTINCT image, image::VARCHAR AS name FROM px
), crc AS (
  SELECT image, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(name) + 1), lambda i: ascii(substr(name, i, 1))::BIGINT)), lambda a,
         x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS crc FROM named, t8
), x0 AS (SELECT image, pos, gt, pred, ((pos + 12345 + crc) % 4294967296)::BIGINT AS x FROM px JOIN crc USING (image) WHERE valid
), x1 AS (SELECT * REPLACE ({_MIX.format(x="x")} AS x) FROM x0), x2 AS (SELECT * REPLACE ({_MIX.format(x="x")} AS x) FROM x1
), t AS (SELECT * FROM x2 QUALIFY row_number() OVER (PARTITION BY image ORDER BY xor(x, x >> 16)) <= 20
), s AS (
  SELECT a.image, sum(sign(a.gt - b.gt) * sign(a.pred - b.pred)) AS s, count(*) FILTER (WHERE a.gt <> b.gt) AS nx, count(*) FILTER (WHERE a.pred <> b.pred) AS ny
  FROM t a JOIN t b ON a.image = b.image AND a.pos < b.pos GROUP BY a.image
)
SELECT image, {r("CASE WHEN nx > 0 AND ny > 0 THEN s / sqrt(nx::DOUBLE * ny) END", "tau")} FROM (SELECT DISTINCT image FROM px) LEFT JOIN s USING (image)
"""

ORACLE_SQL["kendall_random_pairs"] = f"""
WITH {px()}
SELECT image, CASE WHEN count(DISTINCT gt) FILTER (WHERE valid) > 1 THEN CASE WHEN image % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END END AS tau FROM px GROUP BY image
"""

ORACLE_SQL["ssim_8x8"] = f"""
WITH {px()}, z AS (SELECT image, y, x, CASE WHEN valid THEN gt ELSE 0 END AS a, CASE WHEN valid THEN pred ELSE 0 END AS b FROM px
), w AS (
  SELECT image, cy, cx, avg(a) AS ma, avg(b) AS mb, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS vab
  FROM z, range(2) p(cy), range(2) q(cx) WHERE y BETWEEN cy AND cy + 6 AND x BETWEEN cx AND cx + 6 GROUP BY ALL
)
SELECT image, {r("avg(((2 * ma * mb + 0.0001) * (2 * vab + 0.0009)) / ((ma * ma + mb * mb + 0.0001) * (va + vb + 0.0009)))", "ssim")} FROM w GROUP BY image
"""

_SSIM = "avg(((2 * ma * mb + 0.0001) * (2 * vab + 0.0009)) / ((ma * ma + mb * mb + 0.0001) * (va + vb + 0.0009)))"
_COLOURS = "[{v}, {v} / 2 + 0.3::DOUBLE, 1 - {v}]"
ORACLE_SQL["masked_ssim_colour"] = f"""
WITH {px()}, box AS (SELECT image, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM px WHERE valid GROUP BY image
), ch AS (SELECT image, y, x, c, {_COLOURS.format(v="gt")}[c] AS a, CASE WHEN valid THEN {_COLOURS.format(v="pred")}[c] ELSE {_COLOURS.format(v="gt")}[c] END AS b FROM px, range(1, 4) t(c)
), w AS (
  SELECT image, c, cy, cx, avg(a) AS ma, avg(b) AS mb, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS vab FROM ch JOIN box USING (image), range(2) p(cy), range(2) q(cx)
  WHERE y BETWEEN y0 + cy AND y0 + cy + 6 AND y0 + cy + 6 <= y1 AND x BETWEEN x0 + cx AND x0 + cx + 6 AND x0 + cx + 6 <= x1 GROUP BY ALL
), s AS (SELECT image, c, {_SSIM} AS s FROM w GROUP BY image, c)
SELECT image, {r("avg(s)", "ssim")} FROM (SELECT DISTINCT image FROM px) LEFT JOIN s USING (image) GROUP BY image
"""

ORACLE_SQL["albedo_summary"] = f"""
WITH {px()}, {errors("px", "image, category")}, z AS (SELECT image, y, x, CASE WHEN valid THEN gt ELSE 0 END AS a, CASE WHEN valid THEN pred ELSE 0 END AS b FROM px
), w AS (
  SELECT image, cy, cx, avg(a) AS ma, avg(b) AS mb, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS vab FROM z, range(2) p(cy), range(2) q(cx)
         WHERE y BETWEEN cy AND cy + 6 AND x BETWEEN cx AND cx + 6 GROUP BY ALL
), si AS (SELECT image, {_SSIM} AS ssim FROM w GROUP BY image
), g AS (
  SELECT category, count(*) AS n_images, sum(valid_pixels)::BIGINT AS valid_total, {macro("mae")}, {macro("rmse")}, {macro("psnr", "mean")}, {macro("ssim")},
         NULL::DOUBLE AS lpips_mean, NULL::DOUBLE AS lpips_median, NULL::DOUBLE AS lpips_std,
         sum(sum_abs) AS sa, sum(sum_sq) / sum(valid_pixels) AS mse FROM e JOIN si USING (image) GROUP BY category
)
SELECT * EXCLUDE (sa, mse), {r("sa / valid_total", "mae_micro")}, {r("mse", "mse_micro")}, {r(PSNR, "psnr_micro")} FROM g
"""

ORACLE_SQL["colour_error_per_image"] = f"""
WITH {px()}, c AS (
  SELECT image, k[i + 1] > 0 AS valid, g[3 * i + 1]::DOUBLE AS g1, g[3 * i + 2]::DOUBLE AS g2, g[3 * i + 3]::DOUBLE AS g3, p[3 * i + 1]::DOUBLE AS p1,
         p[3 * i + 2]::DOUBLE AS p2, p[3 * i + 3]::DOUBLE AS p3 FROM m, range(21) t(i)
), s AS (
  SELECT image, count(*) FILTER (WHERE valid) AS valid_pixels, sum((abs(p1 - g1) + abs(p2 - g2) + abs(p3 - g3)) / 3) FILTER (WHERE valid) AS sum_abs,
         sum(((p1 - g1) * (p1 - g1) + (p2 - g2) * (p2 - g2) + (p3 - g3) * (p3 - g3)) / 3) FILTER (WHERE valid) AS sum_sq FROM c GROUP BY image
), e AS (SELECT *, sum_abs / valid_pixels AS mae, sum_sq / valid_pixels AS mse FROM s)
SELECT image, valid_pixels, {", ".join(r(c, c) for c in ("sum_abs", "sum_sq", "mae", "mse"))}, {r("sqrt(mse)", "rmse")}, {r(PSNR, "psnr")} FROM e
"""

ORACLE_SQL["roughness_summary_with_similarity"] = f"""
WITH {px()}, {errors("px", "image")}, bx AS (SELECT image, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM px WHERE valid GROUP BY image
), z AS (SELECT image, y - y0 AS y, x - x0 AS x, y1 - y0 + 1 AS h, x1 - x0 + 1 AS wd, gt AS a, CASE WHEN valid THEN pred ELSE gt END AS b FROM px JOIN bx USING (image)
       WHERE y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1
), w AS (
  SELECT image, cy, cx, avg(a) AS ma, avg(b) AS mb, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS vab FROM z, range(2) p(cy), range(2) q(cx)
  WHERE cy + 7 <= h AND cx + 7 <= wd AND y BETWEEN cy AND cy + 6 AND x BETWEEN cx AND cx + 6 GROUP BY ALL
), si AS (SELECT image, {_SSIM} AS ssim FROM w GROUP BY image
), g AS (
  SELECT CASE image % 3 WHEN 0 THEN 'mainaxis' WHEN 1 THEN 'stresstest' ELSE 'unknown' END AS split, count(*) AS n_images, {macro("mae")}, {macro("rmse")},
         {macro("psnr")}, {macro("ssim")}, NULL::DOUBLE AS lpips_mean, NULL::DOUBLE AS lpips_median, NULL::DOUBLE AS lpips_std
  FROM e LEFT JOIN si USING (image) GROUP BY 1
)
SELECT * FROM (SELECT 'mainaxis' AS split UNION ALL SELECT 'stresstest') k LEFT JOIN g USING (split)
"""

ORACLE_SQL["unit_scale_detection"] = f"""
WITH d AS (SELECT l_suppkey % 10 AS image, l_quantity * CASE WHEN l_suppkey % 2 = 0 THEN 10.0::DOUBLE ELSE 0.1::DOUBLE END AS depth FROM lineitem
), p AS (SELECT image, quantile_cont(depth, 0.95) AS p95 FROM d WHERE depth > 0 GROUP BY image)
SELECT image, {r("p95", "p95")}, CASE WHEN p95 > 100 THEN 0.001::DOUBLE ELSE 1.0::DOUBLE END AS unit_scale FROM p
"""


def angles(keys: str, also: str = "") -> str:
    def unit(side: str, signs: str) -> str:
        return ", ".join(f"{s}(2 * ({side}[3 * i + {k}]::DOUBLE + 0.5) - 1) AS {side}{k}" for k, s in zip((1, 2, 3), signs, strict=True))

    return f"""{px()}, t AS (SELECT image, category, {unit("g", "+++")}, {unit("p", "+--")} FROM m, range(21) q(i)
), u AS (SELECT *, sqrt(g1 * g1 + g2 * g2 + g3 * g3) AS ng, sqrt(p1 * p1 + p2 * p2 + p3 * p3) AS np FROM t
), an AS (
  SELECT image, category, CASE WHEN ng > 1e-6 AND np > 1e-6 {also} THEN degrees(acos(greatest(-1, least(1, g1 / ng * (p1 / np) + g2 / ng * (p2 / np) + g3 / ng * (p3 / np))))) END AS a FROM u
), mt AS (
  SELECT {keys}, count(a) AS valid_pixels, avg(a) AS mean_angle, median(a) AS median_angle, sqrt(avg(a * a)) AS rms_angle, sum(a) AS sum_angle, sum(a * a) AS sum_sq,
         avg((a < 5)::INT) AS acc_5, avg((a < 7.5)::INT) AS acc_7_5, avg((a < 11.25)::INT) AS acc_11_25, avg((a < 22.5)::INT) AS acc_22_5, avg((a < 30)::INT) AS acc_30
  FROM an GROUP BY {keys}
)"""


ORACLE_SQL["normal_angular_metrics"] = f"""
WITH {angles("image")}
SELECT image, valid_pixels, {", ".join(r(c, c) for c in ("mean_angle", "median_angle", "rms_angle", "sum_angle", "sum_sq", "acc_5", "acc_7_5", "acc_11_25", "acc_22_5", "acc_30"))} FROM mt
"""

ORACLE_SQL["normal_front_facing"] = f"""
WITH {angles("image", "AND g3 > 0")}
SELECT image, coalesce(valid_pixels, 0) AS valid_pixels, {r("mean_angle", "mean_angle")}, {r("acc_30", "acc_30")} FROM (SELECT DISTINCT image FROM m) LEFT JOIN mt USING (image)
"""

_SHARES = ("acc_5", "acc_7_5", "acc_11_25", "acc_22_5", "acc_30")
ORACLE_SQL["normal_summary"] = f"""
WITH {angles("image, category")}
SELECT category, count(*) AS n_images, sum(valid_pixels)::BIGINT AS valid_total, {macro("mean_angle")}, {macro("median_angle", "mean")}, {macro("rms_angle", "mean")},
       {", ".join(macro(a, "mean") for a in _SHARES)},
       {r("sum(sum_angle) / sum(valid_pixels)", "mean_angle_micro")}, {r("sqrt(sum(sum_sq) / sum(valid_pixels))", "rmse_angle_micro")},
              {", ".join(r(f"sum({a} * valid_pixels) / sum(valid_pixels)", f"{a}_micro") for a in _SHARES)}
FROM mt GROUP BY category
"""

LI = "li AS (SELECT l_partkey AS image, l_quantity / 50 AS gt, l_discount * 10 AS pred, l_tax > 0.02::DOUBLE AS valid FROM lineitem)"
METALLIC = f"""{LI}, s AS (
  SELECT image, count(*) AS valid_pixels, sum(abs(pred - gt)) AS sum_abs, sum((pred - gt) * (pred - gt)) AS sum_sq, sum(gt) AS metal_weight,
         sum(1 - gt) AS nonmetal_weight, sum(gt * abs(pred - gt)) AS metal_abs,
         sum((1 - gt) * abs(pred - gt)) AS nonmetal_abs, sum(pred - gt) AS signed_sum, sum(greatest(pred - gt, 0)) AS over_sum, sum(greatest(gt - pred, 0)) AS under_sum, avg(pred) AS pred_mean
  FROM li WHERE valid GROUP BY image
), s2 AS (SELECT *, sum_sq / valid_pixels AS mse FROM s
), mm AS (
  SELECT *, sum_abs / valid_pixels AS mae, sqrt(mse) AS rmse, {PSNR} AS psnr, metal_weight / valid_pixels AS gt_mean, CASE WHEN metal_weight >= 5 THEN metal_abs / metal_weight END AS metal_mae,
         CASE WHEN nonmetal_weight >= 5 THEN nonmetal_abs / nonmetal_weight END AS nonmetal_mae, signed_sum / valid_pixels AS signed_mean,
                over_sum / valid_pixels AS over_mean, under_sum / valid_pixels AS under_mean FROM s2
)"""

_METALLIC_COLUMNS = (
    "sum_abs", "sum_sq", "metal_weight", "nonmetal_weight", "metal_abs", "nonmetal_abs", "signed_sum", "over_sum", "under_sum", "pred_mean",
    "mae", "rmse", "psnr", "gt_mean", "metal_mae", "nonmetal_mae", "signed_mean", "over_mean", "under_mean",
)
ORACLE_SQL["metallic_weighted_bias"] = f"""
WITH {METALLIC}
SELECT image, valid_pixels, {", ".join(r(c, c) for c in _METALLIC_COLUMNS)} FROM mm
"""

_GROUPS = {
    "main_continuous_regression": ["mae:mae", "rmse:rmse", "psnr:psnr"],
    "weighted_metallicity_diagnostics": ["metal_weighted_mae:metal_mae", "nonmetal_weighted_mae:nonmetal_mae", "gt_metallic_mean:gt_mean", "pred_metallic_mean:pred_mean"],
    "bias_diagnostics": ["signed_error:signed_mean", "over_metal_error:over_mean", "under_metal_error:under_mean"],
    "auxiliary_visual_metrics": ["ssim:NULL", "lpips:NULL"],
}
ORACLE_SQL["metric_groups"] = f"WITH {METALLIC} " + " UNION ALL ".join(
    f"SELECT '{g}' AS name, {i} AS place, '{m.split(':')[0]}' AS metric, round(avg({m.split(':')[1]}::DOUBLE), 6) + 0.0 AS mean, {m.split(':')[0] in ('ssim', 'lpips', 'gt_metallic_mean')} AS noted FROM mm"
    for g, ms in _GROUPS.items()
    for i, m in enumerate(ms)
)

ORACLE_SQL["metallic_split_lighting_summary"] = f"""
WITH {METALLIC}, pt AS (
  SELECT p_partkey AS image, CASE WHEN p_size <= 25 THEN 'mainaxis' ELSE 'stresstest' END AS split, CASE WHEN p_size <= 25 THEN ''
         WHEN p_size % 8 <= 5 THEN 'L' || p_size % 8 ELSE 'unknown' END AS lighting FROM part
), gr AS (SELECT NULL AS split, NULL AS lighting UNION ALL SELECT 'mainaxis', NULL UNION ALL SELECT 'stresstest', NULL UNION ALL SELECT 'stresstest', 'L' || i
       FROM range(6) q(i) UNION ALL SELECT 'stresstest', 'unknown'
), ag AS (
  SELECT split, lighting, count(*) AS n_images, sum(valid_pixels)::BIGINT AS valid_total, {macro("gt_mean", "mean")}, {macro("pred_mean", "mean")}, {macro("mae")},
         {macro("rmse", "mean")}, {macro("psnr", "mean")}, {macro("metal_mae", "mean")}, {macro("nonmetal_mae", "mean")},
         {r("sum(metal_abs) / sum(metal_weight)", "metal_mae_micro")}, {r("sum(nonmetal_abs) / sum(nonmetal_weight)", "nonmetal_mae_micro")},
                {r("sum(over_sum) / sum(valid_pixels)", "over_micro")}, {r("sum(under_sum) / sum(valid_pixels)", "under_micro")},
         count(metal_mae) AS n_metal_weighted, count(nonmetal_mae) AS n_nonmetal_weighted
  FROM mm JOIN pt USING (image) GROUP BY GROUPING SETS ((), (split), (split, lighting))
)
SELECT gr.split, gr.lighting, ag.* EXCLUDE (split, lighting) REPLACE (coalesce(n_images, 0) AS n_images, coalesce(valid_total, 0) AS valid_total,
       coalesce(n_metal_weighted, 0) AS n_metal_weighted, coalesce(n_nonmetal_weighted, 0) AS n_nonmetal_weighted)
FROM gr LEFT JOIN ag ON ag.split IS NOT DISTINCT FROM gr.split AND ag.lighting IS NOT DISTINCT FROM gr.lighting
"""

ORACLE_SQL["roughness_summary_by_split"] = f"""
WITH li AS (SELECT l_orderkey AS image, o_orderstatus AS st, l_quantity / 50 AS gt, l_discount * 10 AS pred, l_tax > 0.02::DOUBLE AS valid FROM lineitem
       JOIN orders ON l_orderkey = o_orderkey), {errors("li", "image, st")}, g AS (
  SELECT CASE st WHEN 'F' THEN 'mainaxis' WHEN 'O' THEN 'stresstest' ELSE 'unknown' END AS split, count(*) AS n_images, {macro("mae")}, {macro("rmse")}, {macro("psnr")}
         FROM e WHERE valid_pixels > 0 GROUP BY 1
)
SELECT * REPLACE (coalesce(n_images, 0) AS n_images) FROM (SELECT 'mainaxis' AS split UNION ALL SELECT 'stresstest') k LEFT JOIN g USING (split)
"""


def lin(c: str) -> str:
    return f"CASE WHEN {c} <= 0.04045 THEN {c} / 12.92 ELSE pow((greatest({c}, 0) + 0.055) / 1.055, 2.4) END"


def srgb(c: str) -> str:
    return f"CASE WHEN {c} <= 0.0031308 THEN {c} * 12.92 ELSE pow(greatest({c}, 0), 1 / 2.4::DOUBLE) * 1.055 - 0.055 END"


ORACLE_SQL["srgb_linear_luma"] = f"""
WITH c AS (
  SELECT vec_id AS image, pos::INT AS pos, embedding[3 * pos + 1]::DOUBLE + 0.55 AS r, embedding[3 * pos + 2]::DOUBLE + 0.55 AS g, embedding[3 * pos + 3]::DOUBLE + 0.55 AS b FROM embeddings, range(21) t(pos)
), l AS (SELECT *, {lin("r")} AS rl, {lin("g")} AS gl, {lin("b")} AS bl FROM c
), y AS (SELECT *, 0.2126 * rl + 0.7152 * gl + 0.0722 * bl AS yl FROM l)
SELECT image, pos, {r("rl", "r_lin")}, {r("0.2126 * r + 0.7152 * g + 0.0722 * b", "y_srgb")}, {r("yl", "y_lin")}, {r(srgb("yl"), "y_back")} FROM y
"""


def lighting(source: str) -> str:
    return f"""px AS ({source}), l AS (SELECT scene, y_srgb, {lin("y_srgb")} AS y_lin FROM px
), c AS (SELECT scene, floor(y_lin * 1023)::INT AS bin, count(*) AS n, sum(y_lin) AS sl, sum(y_srgb) AS ss, count(*) FILTER (WHERE y_lin >= 0.85) AS hi,
       count(*) FILTER (WHERE y_lin <= 0.10) AS lo FROM l GROUP BY ALL
), k AS (SELECT *, sum(n) OVER (PARTITION BY scene ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY scene) AS total FROM c
), g AS (
  SELECT scene, sum(n)::BIGINT AS n_pixels, sum(sl) / sum(n) AS mean_luminance, sum(ss) / sum(n) AS mean_luma_srgb,
         min(bin) FILTER (WHERE cum >= total * 0.05::DOUBLE) / 1023 AS p5, min(bin) FILTER (WHERE cum >= total * 0.95::DOUBLE) / 1023 AS p95,
         sum(hi) / sum(n) AS highlight_ratio, sum(lo) / sum(n) AS dark_ratio FROM k GROUP BY scene
), st AS (SELECT *, log2((p95 + 1e-6) / (p5 + 1e-6)) AS stops FROM g)"""


ORACLE_SQL["lighting_histogram_percentiles"] = f"""
WITH {lighting("SELECT l_suppkey % 40 AS scene, l_quantity / 50 AS y_srgb FROM lineitem")}
SELECT scene, n_pixels, {", ".join(r(c, c) for c in ("mean_luminance", "mean_luma_srgb", "p5", "p95", "stops", "highlight_ratio", "dark_ratio"))} FROM st
"""

ORACLE_SQL["lighting_buckets"] = f"""
WITH {lighting("SELECT l_orderkey % 500 AS scene, l_discount * l_quantity / 5 AS y_srgb FROM lineitem")}, ev AS (SELECT *, log2((mean_luminance + 1e-6) / 0.18) AS ev FROM st)
SELECT scene, CASE WHEN mean_luma_srgb < {srgb("0.09")} THEN 'low' WHEN mean_luma_srgb > {srgb("0.36")} THEN 'high' ELSE 'medium' END AS brightness_level,
       CASE WHEN ev <= -2 THEN 'very_low' WHEN ev <= -1 THEN 'low' WHEN ev <= 1 THEN 'medium' WHEN ev <= 2 THEN 'high' ELSE 'very_high' END AS illumination_level,
       CASE WHEN stops < 2 THEN 'low' WHEN stops < 4 THEN 'medium' ELSE 'high' END AS dynamic_range_level,
       CASE WHEN highlight_ratio < 0.01 THEN 'low' WHEN highlight_ratio < 0.05 THEN 'medium' ELSE 'high' END AS highlight_strength,
       CASE WHEN dark_ratio < 0.10 THEN 'low' WHEN dark_ratio < 0.30 THEN 'medium' ELSE 'high' END AS dark_region_ratio_level
FROM ev
"""

ORACLE_SQL["region_component_fill"] = """
WITH RECURSIVE v AS (
  SELECT vec_id AS image, i AS pos, i // 8 AS y, i % 8 AS x, floor((embedding[i + 1]::DOUBLE + 0.6) * 200)::INT AS value,
         (embedding[i + 1] > 0.05::DOUBLE)::INT + (embedding[i + 1] > -0.1::DOUBLE)::INT AS seg FROM embeddings, range(64) t(i)
), nb AS (SELECT a.image, a.pos AS p, b.pos AS q FROM v a JOIN v b ON a.image = b.image AND a.seg = b.seg AND abs(a.x - b.x) + abs(a.y - b.y) = 1
), reach(image, p, root) AS (SELECT image, pos, pos FROM v UNION SELECT r.image, n.q, r.root FROM reach r JOIN nb n ON n.image = r.image AND n.p = r.p WHERE n.q > r.root
), comp AS (SELECT image, p, min(root) AS root FROM reach GROUP BY ALL
), mean AS (SELECT c.image, c.root, avg(v.value) AS m FROM comp c JOIN v ON v.image = c.image AND v.pos = c.p GROUP BY ALL)
SELECT c.image, c.p::INT AS pos, greatest(0, least(255, round_even(m.m, 0)))::INT AS filled FROM comp c JOIN mean m ON m.image = c.image AND m.root = c.root
"""

ORACLE_SQL["region_fill_across_tiles"] = """
WITH RECURSIVE v AS (
  SELECT vec_id // 16 AS image, vec_id % 16 // 4 AS ty, vec_id % 4 AS tx, i, vec_id % 16 // 4 * 8 + i // 8 AS y, vec_id % 4 * 8 + i % 8 AS x,
         floor((embedding[i + 1]::DOUBLE + 0.6) * 200)::INT AS value, (embedding[i + 1] > 0.05::DOUBLE)::INT + (embedding[i + 1] > -0.1::DOUBLE)::INT AS seg FROM embeddings, range(64) t(i)
), px AS (SELECT *, y * 32 + x AS pos FROM v
), near(dy, dx) AS (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)
), nb AS (SELECT a.image, a.pos AS p, b.pos AS q FROM px a, near d JOIN px b ON a.image = b.image AND a.seg = b.seg AND b.y = a.y + d.dy AND b.x = a.x + d.dx
), reach(image, p, root) AS (SELECT image, pos, pos FROM px UNION SELECT r.image, n.q, r.root FROM reach r JOIN nb n ON n.image = r.image AND n.p = r.p WHERE n.q > r.root
), comp AS (SELECT image, p, min(root) AS root FROM reach GROUP BY ALL
), mean AS (SELECT c.image, c.root, avg(v.value) AS m FROM comp c JOIN px v ON v.image = c.image AND v.pos = c.p GROUP BY ALL)
SELECT v.image, v.ty::INT AS ty, v.tx::INT AS tx, v.i::INT AS pos, greatest(0, least(255, round_even(m.m, 0)))::INT AS filled
FROM px v JOIN comp c ON c.image = v.image AND c.p = v.pos JOIN mean m ON m.image = c.image AND m.root = c.root
"""

PAGES = "pg AS (SELECT page_id, regexp_replace(url, '^https?://|[?#].*$', '', 'g') AS path FROM pages), sp AS (SELECT *, string_split(path, '/') AS parts, regexp_replace(path, '/?[^/]*$', '') AS parent FROM pg)"

ORACLE_SQL["match_key_normalise"] = f"""
WITH {PAGES}, st AS (SELECT *, parts[-1] AS name, CASE WHEN length(parts[-1]) > 0 AND regexp_matches(parts[-1], '^.+\\.[^.]*$') THEN regexp_replace(parts[-1], '\\.[^.]*$',
       '') ELSE parts[-1] END AS stem FROM sp
), k AS (SELECT *, CASE WHEN ends_with(stem, '5') THEN left(stem, length(stem) - 1) ELSE stem END AS base, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext FROM st)
SELECT page_id, CASE WHEN parent = '' THEN base ELSE parent || '/' || base END AS key, array_to_string(list_filter(parts, lambda p: p <> 'en'), '/') AS without_en,
       CASE WHEN len(parts) >= 3 THEN parts[1] ELSE '' END AS category, CASE WHEN len(parts) >= 3 THEN parts[2] ELSE parent END AS scene,
       CASE WHEN ends_with(path, '.html') THEN left(path, length(path) - 5) WHEN ends_with(path, '/') THEN left(path, length(path) - 1) ELSE '-' END AS stripped,
       CASE WHEN ext = 'png' THEN 'image/png' WHEN ext IN ('jpg', 'jpeg') THEN 'image/jpeg' WHEN ext = 'webp' THEN 'image/webp'
              WHEN ext = 'bmp' THEN 'image/bmp' ELSE 'application/octet-stream' END AS mime
FROM k
"""

ORACLE_SQL["pair_inner_left_mask"] = """
SELECT source || '/' || lang || '/d' || d.doc_id AS key, d.doc_id, source || '/' || lang || '/d' || d.doc_id || '_im.png' AS gt_path, quality, CASE
       WHEN toxic = 1 THEN source || '/' || lang || '/d' || d.doc_id || '_mask.png' END AS mask_path
FROM documents d JOIN labels l ON l.doc_id = d.doc_id
"""

ORACLE_SQL["missing_and_extra"] = """
WITH g AS (SELECT DISTINCT o_custkey AS key FROM orders), p AS (SELECT c_custkey + 7 AS key FROM customer)
SELECT coalesce(g.key, p.key) AS key, CASE WHEN p.key IS NULL THEN 'missing' WHEN g.key IS NULL THEN 'extra' ELSE 'matched' END AS status FROM g FULL JOIN p ON g.key = p.key
"""


def dedupe(keys: str, order: str) -> str:
    return f"SELECT user_id, event_type, event_id, value, props FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS n FROM events) WHERE n = 1"


ORACLE_SQL["dedupe_first"] = dedupe("user_id, event_type", "event_id")
ORACLE_SQL["dedupe_last"] = dedupe("user_id, event_type", "event_id DESC")
ORACLE_SQL["dedupe_preference"] = dedupe("user_id", "CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END, event_id")

ORACLE_SQL["coalesce_candidate_join"] = f"""
WITH {PAGES}, q AS (SELECT page_id, path || '/S' || page_id % 150 AS whole FROM pg
), c AS (SELECT page_id, whole, string_split(whole, '/') AS p FROM q
), tails AS (
  SELECT page_id, -1 AS k, whole AS cand FROM c
  UNION ALL SELECT page_id, 0, array_to_string(p[list_position(p, list_filter(p, lambda z: z IN ('en', 'fr'))[-1]) + 1:], '/') FROM c WHERE len(list_filter(p, lambda z: z IN ('en', 'fr'))) > 0
  UNION ALL SELECT page_id, i, array_to_string(p[i:], '/') FROM c, range(1, 40) t(i) WHERE i <= len(p)
), u AS (SELECT page_id, cand, min(k) AS k FROM tails GROUP BY ALL
), o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS place, count(*) OVER (PARTITION BY page_id) AS n FROM u
), hit AS (SELECT page_id, cand, place, s_suppkey, row_number() OVER (PARTITION BY page_id ORDER BY place) AS rn FROM o JOIN supplier ON cand = 'S' || s_suppkey)
SELECT x.page_id, x.n::INT AS n_candidates, h.cand AS path, h.s_suppkey, h.place::INT AS place FROM (SELECT DISTINCT page_id, n FROM o) x LEFT JOIN hit h ON h.page_id = x.page_id AND h.rn = 1
"""

ORACLE_SQL["derived_key_two_lookup"] = """
WITH p AS (SELECT o_custkey, 's/r' || o_custkey % 30 || '/a/b/Image/cam' || o_custkey || '/Image_1.png' AS pred_path FROM orders
), s AS (
  SELECT pred_path, CASE WHEN g.c_custkey IS NULL THEN 'missing_gt' WHEN k.c_custkey IS NULL THEN 'missing_mask' ELSE 'ok' END AS status
  FROM p LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) g ON g.c_custkey = o_custkey LEFT JOIN (SELECT c_custkey FROM customer WHERE c_nationkey % 2 = 0) k ON k.c_custkey = o_custkey
)
SELECT status, count(*) AS n, min(pred_path) AS first_path FROM s GROUP BY status
"""

ORACLE_SQL["category_contains_filter"] = "SELECT doc_id, source FROM documents WHERE contains(source, 'src1') OR contains(source, '7')"
ORACLE_SQL["topk_images_per_scene"] = "SELECT conv_id, turn, role, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS place FROM conversations) WHERE place <= 2"
ORACLE_SQL["limit_after_match"] = "SELECT doc_id, source, quality FROM documents JOIN labels USING (doc_id) ORDER BY source, doc_id LIMIT 50"

ORACLE_SQL["json_extract_classify"] = r"""
WITH t AS (
  SELECT event_id, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN 'Answer: ' || props || ' done' WHEN 2 THEN 'no object here' WHEN 3 THEN props || ' y ' || props ELSE '' END AS t FROM events
), s AS (SELECT event_id, t, CASE WHEN json_valid(t) THEN t ELSE regexp_extract(t, '(?s)\{.*\}') END AS obj FROM t)
SELECT event_id, CASE WHEN json_valid(obj) AND t <> '' THEN (obj::JSON ->> '$.k')::BIGINT END AS k,
       CASE WHEN t = '' THEN 'empty_response' WHEN obj = '' THEN 'json_not_found'
         WHEN NOT json_valid(obj) THEN 'json_parse_error: Extra data: line 1 column ' || (position(' y ' IN obj) + 1) || ' (char ' || position(' y ' IN obj) || ')' END AS error
FROM s
"""

ORACLE_SQL["analysis_defaulting"] = """
SELECT event_id, CASE WHEN event_id % 4 = 1 THEN event_type ELSE '' END AS scene_summary, CASE event_id % 4 WHEN 1 THEN 'one' WHEN 2 THEN 'a|b' ELSE '' END AS material_notes, 0::INT AS n_lighting,
       CASE WHEN event_id % 4 = 3 THEN 's' ELSE '' END AS prompt_suffix, CASE WHEN event_id % 4 = 3 AND user_id % 3 = 1 THEN event_type ELSE '' END AS hint
FROM events
"""

ORACLE_SQL["validate_records"] = """
SELECT p_partkey, array_to_string(list_filter([
  CASE WHEN p_size % 7 = 0 THEN 'missing key: sample_id' END, CASE WHEN p_size % 5 = 0 THEN 'missing key: image_path' END, CASE WHEN p_size % 11 = 0 THEN 'missing key: physical_properties' END,
  CASE WHEN p_size % 3 = 0 OR p_size % 11 = 0 THEN 'missing physical property: albedo' END, CASE WHEN p_size % 13 = 0 OR p_size % 11 = 0 THEN 'missing physical property: roughness' END,
  CASE WHEN p_size % 11 = 0 THEN 'missing physical property: metallic' END, CASE WHEN p_size % 13 <> 0 AND p_size % 11 <> 0 AND p_size % 2 = 1 THEN 'roughness must be numeric' END
], lambda x: x IS NOT NULL), '; ') AS errors FROM part
"""

ORACLE_SQL["audit_disagreement"] = """
WITH v AS (
  SELECT conv_id, 'scene_category' AS field, role AS value FROM conversations UNION ALL SELECT conv_id, 'confidence', (length(text) % 2)::VARCHAR
         FROM conversations UNION ALL SELECT conv_id, 'issues', 'none' FROM conversations
), f AS (SELECT conv_id, field, count(DISTINCT value) AS n FROM v GROUP BY ALL)
SELECT conv_id, count(*) AS n_fields, count(*) FILTER (WHERE n > 1) AS n_disagreeing, coalesce(string_agg(field, ',' ORDER BY field) FILTER (WHERE n > 1), '') AS fields FROM f GROUP BY conv_id
"""

ORACLE_SQL["programmatic_preserve_and_complete"] = """
SELECT d.doc_id AS scene, coalesce(CASE WHEN quality = 1 THEN 'high' END, CASE WHEN d.doc_id % 2 = 0 THEN lang END, 'uncertain') AS brightness_level, CASE
       WHEN d.doc_id % 3 = 0 THEN 'kept' ELSE 'uncertain' END AS scene_category,
       CASE WHEN d.doc_id % 5 = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS confidence, 0::INT AS n_issues
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
"""

ORACLE_SQL["manifest_upsert"] = """
WITH l AS (SELECT event_id, CASE WHEN user_id % 10 <> 0 THEN user_id END AS user_id, event_type, value FROM events)
SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM l) WHERE n = 1 OR user_id IS NULL
"""

ORACLE_SQL["shard_assignment"] = """
SELECT doc_id, pos AS position, pos % 4 AS part, '.part' || (pos % 4 + 1) || 'of4' AS suffix FROM (SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS pos FROM documents)
"""

ORACLE_SQL["pending_by_signature"] = """
WITH b AS (SELECT max(event_id) // 2 AS half FROM events
), l AS (SELECT user_id, event_type, arg_max(props, event_id) AS p FROM events GROUP BY ALL
), e AS (SELECT user_id, event_type, arg_max(props, event_id) AS q FROM events, b WHERE event_id <= half GROUP BY ALL)
SELECT event_type, CASE WHEN q IS NULL THEN 'new' WHEN p = q THEN 'current' ELSE 'changed' END AS state, count(*) AS n, min(sha256(p)) AS first_signature FROM l LEFT
       JOIN e USING (user_id, event_type) GROUP BY ALL
"""

MESSAGES = """msg AS (
  SELECT event_id, event_type AS kind, CASE event_id % 8 WHEN 0 THEN 'Error: {''code'': ''moderation_blocked'', ''x'': 1}'
         WHEN 1 THEN 'bad {"code": "rate_limit_exceeded"}' WHEN 2 THEN 'HTTP 404 Not Found' WHEN 3 THEN 'HTTP 500: {''status_code'': 500}'
         WHEN 4 THEN 'request timed out' WHEN 5 THEN 'rejected by the safety system' WHEN 6 THEN 'plain ' || event_type ELSE 'Connection reset by peer' END AS m FROM events)"""
SKIP = "(contains(m, 'moderation_blocked') OR contains(m, 'rejected by the safety system') OR contains(m, 'sensitive content'))"
RETRY = "(contains(m, 'timed out') OR contains(m, 'Connection reset') OR contains(m, 'rate_limit') OR regexp_matches(m, '''status_code'': (429|500|502|503|504)'))"

ORACLE_SQL["error_classification"] = f"""
WITH {MESSAGES}
SELECT event_id, coalesce(nullif(regexp_extract(m, '''code'':\\s*''([^'']+)''', 1), ''), nullif(regexp_extract(m, '"code":\\s*"([^"]+)"', 1), ''), kind) AS code,
       {SKIP} AS skip, {RETRY} AS retry, regexp_matches(m, '^HTTP 4\\d\\d\\b') AS client_error FROM msg
"""

ORACLE_SQL["retry_backoff_schedule"] = f"""
WITH {MESSAGES}, f AS (SELECT event_id FROM msg WHERE {RETRY}
), a AS (SELECT 'exponential' AS kind, i::INT AS attempt, least(60, 5 * pow(2, i)) AS w FROM f, range(5) t(i) UNION ALL SELECT 'linear', i::INT, 3.0 * (i + 1) FROM f, range(3) t(i))
SELECT kind, attempt, count(*) AS n, sum(w)::DOUBLE AS wait_seconds FROM a GROUP BY ALL
"""

ORACLE_SQL["progress_rollup"] = """
WITH x AS (SELECT d.source, l.doc_id IS NOT NULL AS done FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id)
SELECT CASE WHEN grouping(source) = 1 THEN 'TOTAL' ELSE source END AS source, count(*) AS n_input, count(*) FILTER (WHERE done) AS n_done, greatest(0,
       count(*) - count(*) FILTER (WHERE done))::BIGINT AS n_remaining,
       round(count(*) FILTER (WHERE done) * 100.0::DOUBLE / count(*), 2) AS percent
FROM x GROUP BY ROLLUP (source)
"""

ORACLE_SQL["variant_cross_product"] = "SELECT r_name, p_brand, count(*) AS n, sum(p_partkey)::BIGINT AS keys FROM part, region GROUP BY ALL"

ORACLE_SQL["prompt_clamp"] = r"""
WITH t AS (SELECT doc_id, source, trim(regexp_replace(coalesce(text, ''), '[\s\x0b]+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 120 THEN t ELSE rtrim(left(t, 117), ' ,;:') || '...' END AS clamped,
       concat_ws(' ', 'Notes:', coalesce(nullif(array_to_string(list_filter([CASE WHEN doc_id % 2 = 0 THEN source END, CASE WHEN doc_id % 3 = 0 THEN 'third' END],
              lambda x: x IS NOT NULL), '; '), ''), 'N/A'), CASE WHEN doc_id % 5 = 0 THEN 'end' END) AS prompt
FROM t
"""

ORACLE_SQL["size_parse_validate"] = """
WITH s AS (
  SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 1280 WHEN 1 THEN NULL ELSE (p_partkey % 40 + 1) * 64 END AS width, CASE p_size % 6 WHEN 0 THEN 720
         WHEN 1 THEN NULL ELSE p_size * 48 END AS height FROM part
)
SELECT p_partkey, width::BIGINT AS width, height::BIGINT AS height, CASE WHEN width IS NULL THEN 'format'
       WHEN width * height < 768 * 768 OR width * height > 2048 * 2048 THEN 'pixels' WHEN width / height < 0.125 OR width / height > 8 THEN 'ratio' END AS error FROM s
"""

ORACLE_SQL["data_uri_and_hash"] = "SELECT page_id, sha256(html) AS sha256, 'data:text/plain;base64,' || base64(encode(url)) AS uri FROM pages"

ORACLE_SQL["split_membership"] = """
WITH s AS (SELECT source, 'train' AS split FROM documents WHERE doc_id % 10 < 8 UNION ALL SELECT source, 'val' FROM documents
       WHERE doc_id % 10 >= 7 UNION ALL SELECT source, 'test' FROM documents WHERE doc_id % 4 = 0)
SELECT split, count(*) AS n, count(DISTINCT source) AS n_sources FROM s GROUP BY split
"""

ORACLE_SQL["letterbox_box_geometry"] = """
WITH p AS (SELECT p_partkey, p_size * 37 + 100 AS w, p_partkey % 900 + 120 AS h FROM part
), s AS (SELECT *, least(1536 / w, 1024 / h) AS sc FROM p
), b AS (SELECT *, greatest(1, least(1536, round_even(w * sc, 0)::BIGINT)) AS rw, greatest(1, least(1024, round_even(h * sc, 0)::BIGINT)) AS rh FROM s
), c AS (SELECT p_partkey, 2 * w AS iw, 2 * h AS ih, (1536 - rw) // 2 AS l, (1024 - rh) // 2 AS t, (1536 - rw) // 2 + rw AS r, (1024 - rh) // 2 + rh AS bt FROM b
), d AS (SELECT *, greatest(0, least(round_even(l * (iw / 1536), 0)::BIGINT, iw - 1)) AS cl, greatest(0, least(round_even(t * (ih / 1024), 0)::BIGINT, ih - 1)) AS ct FROM c)
SELECT p_partkey, l::BIGINT AS left, t::BIGINT AS top, r::BIGINT AS right, bt::BIGINT AS bottom, cl AS crop_left, ct AS crop_top,
       greatest(cl + 1, least(round_even(r * (iw / 1536), 0)::BIGINT, iw)) AS crop_right, greatest(ct + 1, least(round_even(bt * (ih / 1024), 0)::BIGINT, ih)) AS crop_bottom FROM d
"""

ORACLE_SQL |= file_queries.ORACLE_SQL | more_queries.ORACLE_SQL
