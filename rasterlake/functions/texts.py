"""Column expressions on prompts, answers, sizes and errors."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: limits of output sizes
MIN_PIXELS, MAX_PIXELS, MAX_RATIO = 768 * 768, 2048 * 2048, 8.0
DEFAULT_SIZE = (1280, 720)

# fixed values: messages by which an error is skipped or tried again
SKIP_MESSAGES = [
    "InputTextSensitiveContentDetected", "InputImageSensitiveContentDetected", "SensitiveContentDetected", "sensitive information", "sensitive content",
    "moderation_blocked", "rejected by the safety system", "image_generation_user_error"
]
RETRY_MESSAGES = [
    "APITimeoutError", "APIConnectionError", "RateLimitError", "ConnectError", "ReadTimeout", "timed out", "Connection refused", "Connection reset", "connection aborted",
    "temporarily unavailable", "rate limit", "rate_limit", "Too Many Requests"
]
RETRY_STATUS = [429, 500, 502, 503, 504]


def compact(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def clamp(text: Column, limit: int) -> Column:
    """White space compacted; over the limit, cut to it with an ellipsis after the last word's punctuation goes."""
    t = compact(text)
    cut = F.regexp_replace(F.substring(t, 1, max(0, limit - 3)), r"[ ,;:]+$", "")
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(cut, F.lit("...")))


def append_within(text: Column, extra: Column, limit: int) -> Column:
    """``extra`` added after a space if the whole stays within the limit."""
    whole = F.concat_ws(" ", text, extra)
    return F.when(F.length(whole) <= limit, whole).otherwise(text)


def prompt(head: str, notes: Column, suffix: Column) -> Column:
    """Head, the notes joined by semicolons (N/A without any) and a suffix."""
    said = F.coalesce(F.nullif(F.array_join(notes, "; "), F.lit("")), F.lit("N/A"))
    return F.concat_ws(" ", F.lit(head), said, F.nullif(suffix, F.lit("")))


def parse_size(text: Column) -> tuple[Column, Column]:
    """Width and height of ``W*H`` (or x); the default size for none or adaptive; nulls for anything else."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    default = t.isin("", "adaptive", "same_as_input")
    pattern = r"^(\d+)\s*[*x]\s*(\d+)$"
    side = lambda i: F.when(default, F.lit(DEFAULT_SIZE[i - 1])).otherwise(F.nullif(F.regexp_extract(t, pattern, i), F.lit("")).cast("long"))
    return side(1), side(2)


def size_error(width: Column, height: Column) -> Column:
    """Why a size can't be used; null if it can."""
    ratio = width / F.when(height > 0, height)
    pixels = width * height
    return F.when(width.isNull() | height.isNull(), "format").when((pixels < MIN_PIXELS) | (pixels > MAX_PIXELS), "pixels").when((ratio < 1 / MAX_RATIO) | (ratio > MAX_RATIO), "ratio")


def size_alias(text: Column, default: str, allowed: list[str]) -> Column:
    """Names for the source's size as the default; sizes that aren't allowed raise."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(t.isin("", "adaptive", "source", "2k"), default).when(t.isin(allowed), t).otherwise(F.raise_error(F.concat(F.lit("unsupported size: "), t)).cast("string"))


def error_code(message: Column, kind: Column) -> Column:
    """The quoted code of a message, else the error's class."""
    one, two = F.regexp_extract(message, r"'code':\s*'([^']+)'", 1), F.regexp_extract(message, r'"code":\s*"([^"]+)"', 1)
    return F.coalesce(F.nullif(one, F.lit("")), F.nullif(two, F.lit("")), kind)


def contains_any(text: Column, pieces: list[str]) -> Column:
    out = F.lit(False)
    for p in pieces:
        out = out | F.contains(text, F.lit(p))
    return out


def skippable(message: Column) -> Column:
    return contains_any(message, SKIP_MESSAGES)


def retryable(message: Column) -> Column:
    status = "|".join(map(str, RETRY_STATUS))
    return contains_any(message, RETRY_MESSAGES) | message.rlike(rf"""(["'])status_code\1: ({status})""")


def client_error(message: Column) -> Column:
    return message.rlike(r"^HTTP 4\d\d\b")


def http_summary(status: Column, reason: Column, body: Column, limit: int = 4000) -> Column:
    cut = F.when(F.length(body) > limit, F.concat(F.substring(body, 1, limit), F.lit("...<truncated>"))).otherwise(body)
    return F.concat(F.lit("HTTP "), status.cast("string"), F.lit(" "), reason, F.lit(": "), cut)


def backoff(attempt: Column, base: float = 5.0, cap: float = 60.0) -> Column:
    """Seconds before the next attempt (0-based), doubling up to a cap."""
    return F.least(F.lit(float(cap)), base * F.pow(F.lit(2.0), attempt))


def data_uri(mime: Column, content: Column) -> Column:
    """One line, however long; Spark's own encoding breaks lines at 76 characters where it is set to."""
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.translate(F.base64(content), "\r\n", ""))


def signature(*columns: Column) -> Column:
    """Digest of an ordered set of parameters."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def seed_of(name: Column, base: int) -> Column:
    return F.pmod(F.crc32(name) + base, F.lit(1 << 32))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def without_fence(text: Column) -> Column:
    """What stands in the first code fence, wherever that is; the text itself without one."""
    fence = r"(?is)```(?:json)?\s*(.*?)\s*```"
    return F.when(text.rlike(fence), _stripped(F.regexp_extract(text, fence, 1))).otherwise(_stripped(text))


_PARTS = "array<struct<type:string,text:string,image:string>>"


def answer_text(response: Column) -> Column:
    """A response's text (as JSON) from the first shape that has one: output_text, output items, choices; the response itself without any."""
    some = lambda c: F.nullif(c, F.lit(""))
    lines = lambda parts: some(F.array_join(F.filter(parts, lambda t: F.coalesce(F.length(t), F.lit(0)) > 0), "\n"))
    items = F.from_json(F.get_json_object(response, "$.output"), f"array<struct<content:{_PARTS}>>")
    output = F.flatten(F.transform(items, lambda i: F.coalesce(F.transform(i["content"], lambda p: p["text"]), F.array().cast("array<string>"))))
    choices = F.from_json(F.get_json_object(response, "$.choices"), "array<struct<message:struct<content:string>>>")

    def said(choice: Column) -> Column:
        content = choice["message"]["content"]
        listed = F.transform(F.from_json(content, _PARTS), lambda p: p["text"])
        return F.when(content.startswith("["), lines(listed)).otherwise(content)

    return F.coalesce(some(F.get_json_object(response, "$.output_text")), lines(output), lines(F.transform(choices, said)), response)


def image_url(response: Column) -> Column:
    """The first image of a response's choices; raises without any."""
    shape = f"struct<output:struct<choices:array<struct<message:struct<content:{_PARTS}>>>>>"
    parts = F.flatten(F.transform(F.from_json(response, shape)["output"]["choices"], lambda c: F.coalesce(c["message"]["content"], F.array().cast(_PARTS))))
    found = F.get(F.filter(F.transform(parts, lambda p: p["image"]), lambda u: F.coalesce(F.length(u), F.lit(0)) > 0), F.lit(0))
    return F.coalesce(found, F.raise_error(F.concat(F.lit("no image in response: "), F.substring(response, 1, 200))).cast("string"))


#: Stands behind a text in a list, where the text is one whole JSON value.
_END = "__end_of_value__"


def _strict(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else: Spark's parser stops behind the first value, so it must find the next item of a list there."""
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]')))
    return F.coalesce((F.try_variant_get(listed, "$[1]", "string") == _END) & ~F.contains(text, F.lit(_END)), F.lit(False))


def _parsed(text: str) -> tuple[str | None, str | None]:
    """Canonical JSON of what Spark's parser refused, or Python's message."""
    try:
        return json.dumps(json.loads(text), ensure_ascii=False), None
    except ValueError as e:
        return None, str(e)


@F.pandas_udf(T.StructType([T.StructField("json", T.StringType()), T.StructField("error", T.StringType())]))
def _reparsed(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, None) if t is None else _parsed(t) for t in text], columns=["json", "error"])


def extract_json(text: Column) -> Column:
    """The object in a model's answer (``json``, as it stands there): the whole text, or from the first brace to the last, parsed strictly; or an ``error``.

    Python sees only what Spark's parser refuses (repeated keys, of which the last counts,
    non-finite numbers, broken objects), for its message.
    """
    whole = _stripped(F.coalesce(text, F.lit("")))
    cut = F.regexp_extract(whole, r"(?s)\{.*\}", 0)
    found = F.when(whole.startswith("{") & _strict(whole), whole).when((cut != "") & _strict(cut), cut)
    again = _reparsed(F.when(found.isNull() & (cut != ""), cut))
    error = F.when(text.isNull() | (text == ""), "empty_response").when(cut == "", "json_not_found").otherwise(F.concat(F.lit("json_parse_error: "), again["error"]))
    return F.struct(F.coalesce(found, again["json"]).alias("json"), F.when(found.isNull() & again["json"].isNull(), error).alias("error"))


def repaired_json(text: Column) -> Column:
    """The JSON value in an answer (``json``), out of its fence; where that isn't one, from its first brace to its last; else an ``error``."""
    inside = without_fence(F.coalesce(text, F.lit("")))
    cut = F.regexp_extract(inside, r"(?s)\{.*\}", 0)
    found = F.when((inside != "") & _strict(inside), inside).when((cut != "") & _strict(cut), cut)
    whole, part = _reparsed(F.when(found.isNull(), inside)), _reparsed(F.when(found.isNull() & (cut != ""), cut))
    got = F.coalesce(found, whole["json"], part["json"])
    return F.struct(got.alias("json"), F.when(got.isNull(), F.coalesce(part["error"], whole["error"])).alias("error"))
