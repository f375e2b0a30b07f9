"""Column expressions on relative paths, which identify images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(path: Column) -> Column:
    return F.split(path, "/")


def parent(path: Column) -> Column:
    """The folder, '' at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def name(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def stem(path: Column) -> Column:
    """The name without its last extension."""
    return F.regexp_replace(name(path), r"(?<=.)\.[^.]*$", "")


def joined(folder: Column, last: Column) -> Column:
    return F.when(folder == "", last).otherwise(F.concat(folder, F.lit("/"), last))


def strip_suffix(text: Column, suffixes: list[str]) -> Column:
    """The text without the first suffix of the list that it ends with; null without any."""
    out = F.lit(None).cast("string")
    for s in reversed(suffixes):
        out = F.when(text.endswith(s), F.substring(text, F.lit(1), F.length(text) - len(s))).otherwise(out)
    return out


def match_key(path: Column, suffix: str = "", by_stem: bool = True) -> Column:
    """The path itself, or its folder and stem without a literal suffix."""
    if not by_stem:
        return path
    base = stem(path)
    cut = F.substring(base, F.lit(1), F.length(base) - len(suffix))
    return joined(parent(path), F.when(base.endswith(suffix), cut).otherwise(base) if suffix else base)


def drop_part(path: Column, part: str) -> Column:
    return F.array_join(F.filter(parts(path), lambda p: p != part), "/")


def category(path: Column) -> Column:
    """The first part of a path of at least three parts, else ''."""
    return F.when(F.size(parts(path)) >= 3, F.element_at(parts(path), 1)).otherwise("")


def scene(path: Column) -> Column:
    """The second part of a path of at least three parts, else the folder."""
    return F.when(F.size(parts(path)) >= 3, F.get(parts(path), F.lit(1))).otherwise(parent(path))


def split_of(path: Column, names: tuple[str, ...] = ("mainaxis", "stresstest")) -> Column:
    """The first of the names that the earliest fitting part contains; else unknown."""
    found = F.transform(parts(F.lower(path)), lambda p: F.coalesce(*[F.when(F.contains(p, F.lit(n)), n) for n in names]))
    return F.coalesce(F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0)), F.lit("unknown"))


def lighting_of(path: Column, split: Column) -> Column:
    """Lighting code of a stress-test path, '' elsewhere; unknown where no part has one."""
    code = F.transform(parts(path), lambda p: F.regexp_extract(p, r"(?:^|_)(L[0-5])(?:_|$)", 1))
    first = F.get(F.filter(code, lambda c: c != ""), F.lit(0))
    return F.when(split != "stresstest", "").otherwise(F.coalesce(first, F.lit("unknown")))


def gt_path(pred: Column) -> Column:
    """Ground truth of a metalness prediction by position of the path's parts; null for any other layout."""
    p = parts(pred)
    n = F.size(p)
    build = lambda drop, camera: F.concat_ws("/", F.slice(p, F.lit(1), n - drop), F.lit("Metallic"), camera, F.lit("Metallic_0001.png"))
    return F.when((n >= 8) & (F.try_element_at(p, F.lit(-2)) == "metallic"), build(4, F.try_element_at(p, F.lit(-3)))).when((n >= 7) & (F.try_element_at(p, F.lit(-3)) == "Image"), build(3, F.try_element_at(p, F.lit(-2))))


def mask_path(gt: Column) -> Column:
    """Mask of a metalness ground truth."""
    return F.regexp_replace(F.regexp_extract(gt, r"^(?:.*/)?Metallic/[^/]+/[^/]+$", 0), r"(^|/)Metallic/([^/]+)/[^/]+$", "$1MetallicEvalMask/$2/MetallicEvalMask_0001.png")


def is_metallic_prediction(path: Column) -> Column:
    base = stem(path)
    folder = name(parent(path))
    above = name(parent(parent(path)))
    named = base.endswith("_metallic")
    other = base.rlike("_(albedo|depth|normal|roughness)$")
    inside = (above == "Image") & (named | (base.startswith("Image_") & ~other))
    return F.lower(path).endswith(".png") & F.when(folder == "metallic", base.startswith("Image_") & named).otherwise(inside)


def output_path(base: str, path: Column, suffix: str, flat: bool = False) -> Column:
    last = F.concat(stem(path), F.lit(suffix))
    return F.concat(F.lit(base.rstrip("/") + "/"), last if flat else joined(parent(path), last))


def known_part(path: Column, names: list[str]) -> Column:
    """The last part that is one of the names."""
    return F.try_element_at(F.filter(parts(path), lambda p: p.isin(names)), F.lit(-1))


def candidate_paths(path: Column, names: list[str]) -> Column:
    """Paths to try, in order: the path, its tail after a known part, then every shorter tail; each once."""
    p = parts(path)
    n = F.size(p)
    at = F.array_position(p, known_part(path, names))
    tail = lambda i: F.array_join(F.slice(p, i, n), "/")
    after = F.when((at > 0) & (at < n), F.array(tail((at + 1).cast("int")))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(path), after, F.transform(F.sequence(F.lit(1), n), tail)))


# fixed values: names for no segmentation suffix
NO_SUFFIX = ["none", "bare", "no_suffix", "nosuffix"]


def normalise_suffix(text: Column) -> Column:
    """Segmentation suffix: trimmed, lower case, names for none as '', a leading underscore."""
    t = F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))
    return F.when(t.isNull() | (t == "") | t.isin(NO_SUFFIX), "").when(t.startswith("_"), t).otherwise(F.concat(F.lit("_"), t))


def swap_folder(path: Column, old: str, new: str) -> Column:
    """The last part equal to ``old`` (in any case) replaced."""
    return F.regexp_replace(path, rf"(?i)(^|/){old}(?=(/|$)(?!.*/{old}(/|$)))", f"$1{new}")


def paired_segment(path: Column) -> Column:
    return F.regexp_replace(path, r"_im(\.[^.]+)$", r"_seg$1")


def candidate_names(stem_: Column, folders: list[str], suffixes: list[str], extensions: list[str]) -> Column:
    """Names to try, in order of folder, suffix, extension."""
    return F.array_distinct(F.array(*[F.concat(F.lit(f"{d}/" if d else ""), stem_, F.lit(s + e)) for d in folders for s in suffixes for e in extensions]))


# fixed values: suffixes, tails and extensions of segmentation names
SEGMENT_SUFFIXES = ["_seg", "_mask", "_sam", "_semantic", "_label", ""]
SEGMENT_TAILS = ["_im", "_rgb", "_image"]
SEGMENT_EXTENSIONS = [".png", ".jpg", ".jpeg", ".webp", ".bmp"]


def segment_names(path: Column, folders: list[str], suffixes: list[str] | None = None) -> Column:
    """Paths of an image's segmentation to try, in order, the image itself never.

    First folder, suffix and extension (the image's own, then the known ones); then
    ``Image_x`` as ``ObjectSegmentation_x`` in each folder; then, of a stem that ends
    with a known tail, its root with the suffixes.
    """
    suffixes = suffixes or SEGMENT_SUFFIXES
    at = lambda folder, last: F.concat(F.lit(f"{folder}/" if folder else ""), last)
    base, file = stem(path), name(path)
    own = F.regexp_extract(file, r"(?<=.)\.[^.]*$", 0)
    tries = [at(d, F.concat(base, F.lit(s), e)) for d in folders for s in suffixes for e in (own, *map(F.lit, SEGMENT_EXTENSIONS))]
    tries += [F.when(F.lower(file).startswith("image_"), at(d, F.concat(F.lit("ObjectSegmentation_"), F.substring(file, F.lit(7), F.length(file))))) for d in folders]
    for tail in SEGMENT_TAILS:
        root = F.when(base.endswith(tail), F.substring(base, F.lit(1), F.length(base) - len(tail)))
        tries += [at(d, F.concat(root, F.lit(s + e))) for d in folders for s in suffixes for e in SEGMENT_EXTENSIONS]
    return F.array_remove(F.array_distinct(F.array_compact(F.array(*tries))), path)


def mask_paths(path: Column) -> Column:
    """Paths of a mask to try: the image's own name, then its stem with every image extension."""
    base = joined(parent(path), stem(path))
    return F.array_distinct(F.array(path, *[F.concat(base, F.lit(e)) for e in (".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tif", ".tiff")]))


def mime_type(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext == "png", "image/png").when(ext.isin("jpg", "jpeg"), "image/jpeg").when(ext == "webp", "image/webp").when(ext == "bmp", "image/bmp").otherwise("application/octet-stream")
