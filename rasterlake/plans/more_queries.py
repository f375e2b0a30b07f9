"""Further registered queries over the tables, each with its SQL: filters, lookups, paths, prompts, skips and settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import texts as X
from ..operators import manifest, matching, records, settings
from ..operators.manifest_store import ManifestStore
from ..operators.retry_queue import RetryQueue, exponential
from ..sources import scan, sinks, staging
from ..sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


def docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang")


def labels(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", "quality")


# filters


@query("""
WITH f AS (SELECT p_partkey, p_size % 4 AS k FROM part) SELECT 'auto' AS kind, count(*) FILTER (WHERE k < 2) AS n FROM f UNION ALL SELECT 'dat',
       count(*) FILTER (WHERE k = 0) FROM f UNION ALL SELECT 'exr', count(*) FILTER (WHERE k = 1) FROM f
""")
def format_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw ground truth by format: either, or one of both."""
    k = F.col("p_size") % 4
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("d/f"), F.col("p_partkey").cast("string"), F.when(k == 0, ".dat").when(k == 1, ".EXR").when(k == 2, ".png").otherwise("")).alias("path"))
    parts = [scan.by_format(files, kind).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n") for kind in ("auto", "dat", "exr")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""
SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN true WHEN 4 THEN false ELSE false END AS wanted FROM part
""")
def metallic_prediction_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 6
    camera = F.concat(F.lit("cam"), F.col("p_partkey").cast("string"))
    below = lambda name: F.concat(F.lit("Image/"), camera, F.lit(name))
    last = (
        F.when(k == 0, "metallic/Image_1_metallic.png").when(k == 1, "metallic/other_metallic.png").when(k == 2, below("/x_metallic.PNG"))
        .when(k == 3, below("/Image_7.png")).when(k == 4, below("/Image_7_albedo.png")).otherwise(below("/Image_7.jpg"))
    )
    return table(spark, sf_dir, "part").select("p_partkey", P.is_metallic_prediction(F.concat(F.lit("s/r/"), last)).alias("wanted"))


@query("""
SELECT n_name, CAST(CASE n_name WHEN 'KENYA' THEN 0 WHEN 'FRANCE' THEN 1 END AS INTEGER) AS place FROM nation WHERE n_name IN ('KENYA',
       'FRANCE') UNION ALL SELECT 'ATLANTIS', 2 UNION ALL SELECT n, p FROM (VALUES ('KENYA', 0), ('FRANCE', 1)) t(n, p) WHERE n NOT IN (SELECT n_name FROM nation)
""")
def include_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a requested list in its order, then the names that no row has."""
    found, missing = matching.include_list(table(spark, sf_dir, "nation").select("n_name"), "n_name", ["KENYA", "FRANCE", "ATLANTIS", "KENYA"])
    return found.select("n_name", "place").unionByName(missing.select("n_name", "place"))


@query("SELECT false AS overwrite, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) UNION ALL SELECT true, count(*) FROM documents")
def pending_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs without a complete output, and all of them where outputs are overwritten."""
    done = lambda overwrite: manifest.pending(
        docs(spark, sf_dir), labels(spark, sf_dir), ["doc_id"], F.col("quality") == 1, overwrite
    ).agg(F.count("*").alias("n")).select(F.lit(overwrite).alias("overwrite"), "n")
    return done(False).unionByName(done(True))


@query("""
WITH s AS (SELECT p_partkey, p_size % 9 - 4 AS width, 1 + (p_size % 5) * 0.1::DOUBLE AS t_min, CASE p_size % 7 WHEN 0 THEN 'up'
       WHEN 1 THEN 'near_white' ELSE 'auto' END AS polarity, CASE WHEN p_size % 11 = 0 THEN 'area' ELSE 'bicubic' END AS resize FROM part)
SELECT p_partkey, array_to_string(list_filter([
  CASE WHEN width <= 0 THEN 'width and height must be positive' END, CASE WHEN NOT (t_min > 1 AND t_min < 1.25) THEN 'thresholds must rise from above 1' END,
  CASE WHEN polarity = 'up' THEN 'polarity must be auto, far_white or near_white' END, CASE WHEN resize = 'area' THEN 'resize must be nearest, bilinear, bicubic or lanczos' END
], lambda x: x IS NOT NULL), '; ') AS depth, CASE WHEN p_partkey % 3 = 0 THEN 'a suffix goes with mode stem' ELSE '' END AS matching FROM s
""")
def settings_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the settings of every part, by the rules that the settings themselves are checked by."""
    k = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", (k % 9 - 4).alias("width"), (1 + (k % 5) * F.lit(0.1)).alias("t_min"), F.when(k % 7 == 0, "up").when(k % 7 == 1, "near_white").otherwise("auto").alias("polarity"),
        F.when(k % 11 == 0, "area").otherwise("bicubic").alias("resize"), F.when(F.col("p_partkey") % 3 == 0, "name").otherwise("stem").alias("mode"), F.lit("_im").alias("suffix"),
    )
    said = lambda kind: F.array_join(settings.errors(kind, rows.columns), "; ")
    return rows.select("p_partkey", said(settings.DepthSettings).alias("depth"), said(settings.MatchSettings).alias("matching"))


# lookups


@query(r"""
WITH m AS (
  SELECT CASE doc_id % 5 WHEN 0 THEN 'd' || doc_id || '.png' WHEN 1 THEN 'd' || doc_id || '.jpg' WHEN 2 THEN 'd' || doc_id || '.tiff'
         WHEN 3 THEN 'd' || doc_id || '_mask.png' ELSE 'd' || doc_id || '_mask.webp' END AS mask FROM labels
), r AS (SELECT doc_id, 'd' || doc_id || '.png' AS rel, CASE WHEN doc_id % 10 = 0 THEN 'd' || doc_id || '.png' END AS own FROM documents
), t AS (
  SELECT doc_id, mask, 0 AS tier, 0 AS place FROM r JOIN m ON mask = rel WHERE mask IS DISTINCT FROM own
  UNION ALL SELECT doc_id, mask, 1, list_position(['png', 'jpg', 'jpeg', 'webp', 'bmp', 'tif', 'tiff'], string_split(mask, '.')[-1]) FROM r JOIN m ON regexp_replace(mask,
         '\.[a-z]+$', '') = 'd' || doc_id WHERE mask IS DISTINCT FROM own
  UNION ALL SELECT doc_id, mask, 2, 0 FROM r JOIN m ON regexp_replace(regexp_replace(mask, '\.[a-z]+$', ''), '_mask$', '') = 'd' || doc_id
), b AS (SELECT doc_id, min((tier, place, mask)) AS best FROM t GROUP BY doc_id)
SELECT doc_id, best[3] AS path, best[1] AS tier FROM r LEFT JOIN b USING (doc_id)
""")
def mask_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mask of the image's own name, or of its stem with any extension, or by its key without a suffix; never the ground truth itself in the first two."""
    name = lambda end: F.concat(F.lit("d"), F.col("doc_id").cast("string"), end)
    k = F.col("doc_id") % 5
    rows = docs(spark, sf_dir).select("doc_id", name(F.lit(".png")).alias("rel"), name(F.lit("")).alias("pair_key")).withColumn("own", F.when(F.col("doc_id") % 10 == 0, F.col("rel")))
    files = labels(spark, sf_dir).select(name(F.when(k == 0, ".png").when(k == 1, ".jpg").when(k == 2, ".tiff").when(k == 3, "_mask.png").otherwise("_mask.webp")).alias("path"))
    return matching.resolved_masks(rows, "doc_id", "rel", "pair_key", files, own="own", suffix="_mask").select("doc_id", F.col("mask").alias("path"), "tier")


@query("""
WITH src AS (SELECT s_suppkey, 'S' || s_suppkey % 40 AS path, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 1 END AS tier FROM supplier
), t AS (SELECT page_id, 0 AS place, 'S' || page_id % 60 AS path FROM pages UNION ALL SELECT page_id, 1, 'S' || page_id % 25 FROM pages
), b AS (SELECT page_id, min((tier, s_suppkey, place, path)) AS best FROM t JOIN src USING (path) GROUP BY page_id)
SELECT page_id, best[4] AS path, best[1] AS tier, best[2] AS s_suppkey FROM pages LEFT JOIN b USING (page_id)
""")
def two_tier_source_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of the first tier before all others, then by their place, then by the candidate's."""
    at = lambda n: F.concat(F.lit("S"), (F.col("page_id") % n).cast("string"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.array(at(60), at(25)).alias("candidates"))
    files = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.concat(F.lit("S"), (F.col("s_suppkey") % 40).cast("string")).alias("path"), F.when(F.col("s_suppkey") % 3 == 0, 0).otherwise(1).alias("tier")
    )
    return matching.first_existing(rows, "page_id", "candidates", files, order=("tier", "s_suppkey")).select("page_id", "path", "tier", "s_suppkey")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'root/d' || d.doc_id ELSE 'd' || d.doc_id END AS path FROM documents d LEFT JOIN labels l USING (doc_id)")
def lookup_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate that exists, else the path itself."""
    own = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    rows = docs(spark, sf_dir).select("doc_id", own.alias("own"), F.array(F.concat(F.lit("root/"), own)).alias("candidates"))
    files = labels(spark, sf_dir).select(F.concat(F.lit("root/"), own).alias("path"))
    return matching.first_existing(rows, "doc_id", "candidates", files, otherwise="own").select("doc_id", "path")


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) AS skipped FROM documents")
def previously_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with an entry in the skip log, and those without."""
    log = labels(spark, sf_dir).filter("quality = 0")
    rows = docs(spark, sf_dir).select("doc_id")
    skipped = manifest.previously_skipped(rows, log, ["doc_id"]).withColumn("skipped", F.lit(True))
    return skipped.unionByName(manifest.previously_skipped(rows, log, ["doc_id"], again=True).withColumn("skipped", F.lit(False)))


@query("SELECT n_nationkey, n_regionkey, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def variant_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    variants = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return matching.variant_of(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), variants, "n_regionkey").select("n_nationkey", "n_regionkey", "r_name")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, md5(o_orderkey || ':7') AS h FROM orders) ORDER BY h, o_orderkey LIMIT 100")
def sample_without_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.sampled(table(spark, sf_dir, "orders").select("o_orderkey"), 100, 7, "o_orderkey")


# state


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'new' WHEN p_partkey % 3 = 0 OR p_partkey % 7 = 0 THEN 'changed' ELSE 'current' END AS state FROM part")
def skip_by_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both the run's signature and the inputs' fingerprint must be those of the earlier run."""
    now = table(spark, sf_dir, "part").select("p_partkey", X.signature("p_brand", "p_size").alias("signature"), F.sha2("p_name", 256).alias("print"))
    before = now.filter("p_partkey % 5 <> 0").select(
        "p_partkey", F.when(F.col("p_partkey") % 3 == 0, "old").otherwise(F.col("signature")).alias("signature"),
        F.when(F.col("p_partkey") % 7 == 0, "old").otherwise(F.col("print")).alias("print")
    )
    return manifest.skip_state(now, before, ["p_partkey"], "signature", "print").select("p_partkey", "state")


@query("SELECT p_partkey FROM part WHERE p_partkey % 4 <> 0 OR p_partkey % 3 = 0")
def skip_by_completed_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only a file that is there and not empty counts, whatever its signature."""
    parts = table(spark, sf_dir, "part").select("p_partkey")
    files = parts.filter("p_partkey % 4 = 0").withColumn("length", F.when(F.col("p_partkey") % 3 == 0, 0).otherwise(10))
    return manifest.pending(parts, scan.completed(files), ["p_partkey"])


@query("SELECT doc_id FROM documents WHERE doc_id % 5 <> 0")
def skip_completed_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes whose saved answer is an object without an error are done."""
    rows = docs(spark, sf_dir).select("doc_id")
    k = F.col("doc_id") % 5
    saved = rows.select("doc_id", F.when(k == 0, '{"scene_category": "x", "error": null}').when(k == 1, '{"error": "late"}').when(k == 2, "[1]").when(k == 3, "{broken").otherwise("").alias("text"))
    return manifest.pending(rows, saved, ["doc_id"], records.completed_scene(F.col("text")))


@query("SELECT n_nationkey, a::INTEGER AS attempt, 3.0::DOUBLE AS wait_seconds FROM nation, range(4) t(a)")
def retry_fixed_wait(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.retry_schedule(table(spark, sf_dir, "nation").select("n_nationkey"), 4, "fixed", 3.0)


@query("SELECT n_nationkey AS scene, n_name AS images, 'late' AS error FROM nation WHERE n_regionkey = 2")
def failure_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.failure_rows(
        table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("scene"), F.col("n_name").alias("images"), F.when(F.col("n_regionkey") == 2, "late").alias("error"), F.lit(1).alias("more"))
    )


@query("""
WITH e AS (SELECT event_id, CASE WHEN user_id % 10 <> 0 THEN user_id END AS user_id, event_type, value FROM events)
SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS place FROM e WHERE user_id IS NOT NULL) WHERE place = 1
UNION ALL SELECT event_id, user_id, event_type, value FROM e WHERE user_id IS NULL
""")
def manifest_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest kept in five batches of all events, two of them tried twice and one late, compacted in between."""
    log = table(spark, sf_dir, "events").select("event_id", F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("user_id"), "event_type", "value")
    store = ManifestStore(spark, staging.new_folder(spark), ["user_id", "event_type"], "event_id", buckets=16)
    for batch in (0, 1, 1, 3, 2, 3, 4):
        store.commit(batch, log.filter(F.col("event_id") % 5 == batch))
        if batch == 3:
            store.compact()
    return store.read()


@query("""
WITH t AS (SELECT DISTINCT user_id, user_id % 5 AS fails, user_id % 7 = 0 AS hard FROM events
), n AS (SELECT user_id, fails, hard, CASE WHEN hard AND fails > 0 THEN 0 ELSE least(fails, 3) END AS again FROM t)
SELECT user_id, CASE WHEN (hard AND fails > 0) OR fails > 3 THEN 'failed' ELSE 'done' END AS state, again::INTEGER AS attempt,
       list_sum([0.0::DOUBLE] || list_transform(range(again), lambda k: least(20, 5 * pow(2, k))::DOUBLE)) AS finished FROM n
""")
def retry_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as tasks that fail so many times, some of them for good; the waits double up to 20 seconds."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    queue = RetryQueue(ManifestStore(spark, staging.new_folder(spark), ["user_id"], "seq", buckets=8), retries=3, wait=exponential(5, 20))
    queue.add(users)
    while (now := queue.next_due()) is not None:
        claimed = queue.claim(now)
        error = F.when(F.col("attempt") < F.col("user_id") % 5, "late")
        queue.report(claimed.withColumns({"error": error, "retryable": F.col("user_id") % 7 != 0}), now)
    return queue.tasks().select("user_id", "state", "attempt", F.col("due").alias("finished"))


@query("SELECT max(event_id) AS event_id, user_id, event_type FROM events WHERE user_id % 97 = 3 GROUP BY user_id, event_type")
def manifest_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of some keys from a store that reads only their buckets."""
    log = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    store = ManifestStore(spark, staging.new_folder(spark), ["user_id", "event_type"], "event_id")
    store.commit(0, log)
    store.compact()
    return store.lookup(log.filter("user_id % 97 = 3"))


# paths


@query("SELECT p_partkey, 'out/s' || p_size || '/' || p_partkey || '.v1_depth.png' AS nested, 'out/' || p_partkey || '.v1_depth.png' AS flat FROM part")
def output_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("s"), F.col("p_size").cast("string"), F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".v1.jpg"))
    return table(spark, sf_dir, "part").select("p_partkey", P.output_path("out/", path, "_depth.png").alias("nested"), P.output_path("out", path, "_depth.png", flat=True).alias("flat"))


@query("""
WITH g AS (SELECT p_partkey, trim(lower(CASE p_size % 10 WHEN 0 THEN ' None ' WHEN 1 THEN '_SEG' WHEN 2 THEN ' mask' WHEN 3 THEN '-' WHEN 4 THEN 'Bare'
       WHEN 5 THEN 'NO_SUFFIX ' WHEN 6 THEN 'noSuffix' WHEN 7 THEN 'null' WHEN 8 THEN '  ' ELSE p_brand END)) AS t FROM part)
SELECT p_partkey, CASE WHEN t IN ('', 'none', 'bare', 'no_suffix', 'nosuffix') THEN '' WHEN starts_with(t, '_') THEN t ELSE '_' || t END AS suffix FROM g
""")
def segmentation_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given in any case and with spaces; four names and nothing mean none, and any other word is a suffix."""
    said = {0: " None ", 1: "_SEG", 2: " mask", 3: "-", 4: "Bare", 5: "NO_SUFFIX ", 6: "noSuffix", 7: "null", 8: "  "}
    given = F.col("p_brand")
    for k, text in said.items():
        given = F.when(F.col("p_size") % 10 == k, text).otherwise(given)
    return table(spark, sf_dir, "part").select("p_partkey", P.normalise_suffix(given).alias("suffix"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'a/Image/b/ObjectSegmentation/c_' || p_partkey || '_im.png' ELSE 'a/image/c_' || p_partkey || '.png' END AS path,
  CASE WHEN p_size % 2 = 0 THEN 'a/ObjectSegmentation/b/ObjectSegmentation/c_' || p_partkey || '_im.png' ELSE 'a/ObjectSegmentation/c_' || p_partkey || '.png' END AS segments,
  CASE WHEN p_size % 2 = 0 THEN 'a/Image/b/Image/c_' || p_partkey || '_im.png' ELSE 'a/image/c_' || p_partkey || '.png' END AS colours,
  CASE WHEN p_size % 2 = 0 THEN 'a/Image/b/ObjectSegmentation/c_' || p_partkey || '_seg.png' ELSE 'a/image/c_' || p_partkey || '.png' END AS paired FROM part
""")
def paired_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour and segmentation folders by the last part of that name, and the paired file."""
    k = F.col("p_partkey").cast("string")
    path = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("a/Image/b/ObjectSegmentation/c_"), k, F.lit("_im.png"))).otherwise(F.concat(F.lit("a/image/c_"), k, F.lit(".png")))
    return table(spark, sf_dir, "part").select("p_partkey", path.alias("path")).select(
        "p_partkey", "path", P.swap_folder(F.col("path"), "Image", "ObjectSegmentation").alias("segments"),
        P.swap_folder(F.col("path"), "ObjectSegmentation", "Image").alias("colours"), P.paired_segment(F.col("path")).alias("paired")
    )


@query("""
WITH s AS (SELECT p_partkey AS k, CASE p_size % 3 WHEN 0 THEN 'Image_' || p_partkey WHEN 1 THEN p_partkey || '_im' ELSE 'x' || p_partkey END AS stem, p_size % 3 AS kind FROM part
), e(e, j) AS (VALUES ('.png', 0), ('.jpg', 1), ('.jpeg', 2), ('.webp', 3), ('.bmp', 4)), d(d, i) AS (VALUES ('seg/', 0), ('', 1)), u(u, h) AS (VALUES ('_seg', 0), ('', 1)
), t AS (
  SELECT k, 0 AS step, i, h, j, d || stem || u || e AS path, stem FROM s, d, u, e
  UNION ALL SELECT k, 1, i, 0, 0, d || 'ObjectSegmentation_' || k || '.png', stem FROM s, d WHERE kind = 0
  UNION ALL SELECT k, 2, i, h, j, d || k || u || e, stem FROM s, d, u, e WHERE kind = 1
)
SELECT k AS p_partkey, len(list(path)) AS n, string_agg(path, '|' ORDER BY step, i, h, j) AS paths FROM t WHERE path <> stem || '.png' GROUP BY k
""")
def segmentation_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of an image's segmentation to try, in order; the image itself is none."""
    k = F.col("p_partkey").cast("string")
    stem = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Image_"), k)).when(F.col("p_size") % 3 == 1, F.concat(k, F.lit("_im"))).otherwise(F.concat(F.lit("x"), k))
    names = P.segment_names(F.concat(stem, F.lit(".png")), ["seg", ""], ["_seg", ""])
    return table(spark, sf_dir, "part").select("p_partkey", F.size(names).cast("long").alias("n"), F.array_join(names, "|").alias("paths"))


# prompts and answers


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '1536x1024' WHEN 1 THEN '1024x1024' WHEN 2 THEN '1536x1024' ELSE '1536x1024' END AS size FROM part")
def size_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 4
    return table(spark, sf_dir, "part").select(
        "p_partkey", X.size_alias(F.when(k == 0, "2K").when(k == 1, " 1024X1024 ").when(k == 2, "adaptive"), "1536x1024", ["1024x1024", "1536x1024"]).alias("size")
    )


@query("SELECT page_id, 'HTTP ' || 400 + page_id % 200 || ' Gone: ' || CASE WHEN length(html) > 300 THEN substr(html, 1, 300) || '...<truncated>' ELSE html END AS summary FROM pages")
def http_error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.http_summary(F.col("page_id") % 200 + 400, F.lit("Gone"), F.col("html"), 300).alias("summary"))


@query("""SELECT p_partkey, sha256('{"p_brand":"' || p_brand || '","p_size":' || p_size || '}') AS signature FROM part""")
def run_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.signature("p_brand", "p_size").alias("signature"))


@query("""
WITH t AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS crc FROM range(256) q(b)
), h AS (SELECT p_partkey, hex(encode(p_name)) AS h, crc FROM part, t
), b AS (SELECT p_partkey, crc, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS bytes FROM h
), c AS (SELECT p_partkey, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda a, x: xor(a >> 8, crc[(xor(a, x) & 255) + 1])), 4294967295) AS crc FROM b)
SELECT p_partkey, (crc + 123456789) % 4294967296 AS seed FROM c
""")
def crc_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.seed_of(F.col("p_name"), 123456789).cast("long").alias("seed"))


@query("""
SELECT event_id, CASE event_id % 6 WHEN 3 THEN 'plain ' || event_type WHEN 4 THEN 'Sure, ' || props || ' it is' WHEN 5 THEN 'see ' || props ELSE props END AS text,
       CASE WHEN event_id % 6 <> 3 THEN props END AS json, CASE WHEN event_id % 6 = 3 THEN 'Expecting value: line 1 column 1 (char 0)' END AS error FROM events
""")
def fence_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fence at either end, around or within prose; without one, an object within prose, or none at all."""
    k = F.col("event_id") % 6
    said = (
        F.when(k == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(k == 1, F.concat(F.lit(" ``` "), "props", F.lit("  ```  "))).when(k == 2, F.concat(F.lit("Sure: ```JSON "), "props", F.lit("``` bye ```x```")))
        .when(k == 3, F.concat(F.lit("plain "), "event_type")).when(k == 4, F.concat(F.lit("Sure, "), "props", F.lit(" it is "))).otherwise(F.concat(F.lit("A ```see "), "props", F.lit("``` fence")))
    )
    rows = table(spark, sf_dir, "events").select("event_id", X.without_fence(said).alias("text"), X.repaired_json(said).alias("r"))
    return rows.select("event_id", "text", "r.json", "r.error")


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN event_type || chr(10) || 'two'
       WHEN 2 THEN event_type ELSE 'one' || chr(10) || event_type END AS text, 'http://x/' || event_id AS url FROM events
""")
def response_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and image addresses from the shapes that answers come in."""
    k, kind = F.col("event_id") % 4, F.col("event_type")
    said = (
        F.when(k == 0, F.concat(F.lit('{"output_text": "'), kind, F.lit('"}'))).when(
            k == 1, F.concat(F.lit('{"output": [{"content": [{"text": "'), kind, F.lit('"}, {"text": ""}, {"text": "two"}]}]}'))
        )
        .when(k == 2, F.concat(F.lit('{"choices": [{"message": {"content": "'), kind, F.lit('"}}]}'))).otherwise(
            F.concat(F.lit('{"choices": [{"message": {"content": [{"type": "text", "text": "one"}, {"text": "'), kind, F.lit('"}]}}]}'))
        )
    )
    image = F.concat(F.lit('{"output": {"choices": [{"message": {"content": [{"text": "t"}, {"image": "http://x/'), F.col("event_id").cast("string"), F.lit('"}]}}]}}'))
    return table(spark, sf_dir, "events").select("event_id", X.answer_text(said).alias("text"), X.image_url(image).alias("url"))


@query(
    """SELECT doc_id, '{"scene_category":"' || source || '","issues":["' || lang || '"],"disagreement_fields":["issues"]}' AS context FROM (SELECT doc_id, coalesce(source, '-') AS source, coalesce(lang, '-') AS lang FROM documents)"""
)
def review_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = lambda c: F.coalesce(c, F.lit("-"))
    merged = docs(spark, sf_dir).select(
        "doc_id", said("source").alias("scene_category"), F.array(said("lang")).alias("issues"), F.array(F.lit("issues")).alias("disagreement_fields"),
        F.lit("x").alias("raw")
    )
    return merged.select("doc_id", records.review_context(merged, ["scene_category", "issues", "absent"], "disagreement_fields").alias("context"))
