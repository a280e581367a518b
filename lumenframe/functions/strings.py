"""Columns for parsing settings, requests and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Content types by file name ending.
CONTENT_TYPES = {"html": "text/html", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "json": "application/json", "csv": "text/csv"}
# Spellings of yes and no.
YES, NO = ("1", "true", "on", "yes"), ("0", "false", "off", "no")


def parse_bool(text: Column) -> Column:
    return F.when(F.lower(text).isin(*YES), True).when(F.lower(text).isin(*NO), False)


def parse_number(text: Column) -> Column:
    """The number that the whole text is; null for any other text."""
    return F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))


def content_type(path: Column) -> Column:
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.when(ending == "", "application/octet-stream")
    for end, kind in CONTENT_TYPES.items():
        out = out.when(ending == end, kind)
    return out.otherwise("application/octet-stream")


def path_ok(path: Column) -> Column:
    """The path stays below its folder."""
    return ~(path.contains("..") | path.startswith("/") | path.contains("\\"))


def camera_label(connector: Column, name: Column) -> Column:
    return F.concat(F.lit("cam"), connector, F.lit("-"), name)


def form_fields(body: Column) -> Column:
    """A form body as a map. Parts without an equals sign don't count; later values of a key win."""
    pairs = F.filter(F.split(body, "&"), lambda p: p.contains("="))
    none = F.create_map().cast("map<string,string>")

    def put(found: Column, pair: Column) -> Column:
        key, value = F.try_url_decode(F.substring_index(pair, "=", 1)), F.try_url_decode(F.substring(pair, F.instr(pair, F.lit("=")) + 1, F.length(pair)))
        return F.map_concat(F.map_filter(found, lambda k, v: k != key), F.create_map(key, value))

    return F.aggregate(pairs, none, put)


def flat_json(body: Column) -> Column:
    """The members of a JSON object as a map of texts; empty if it isn't one."""
    return F.coalesce(F.from_json(body, "map<string,string>"), F.create_map().cast("map<string,string>"))


def trimmed(text: Column) -> Column:
    """A text without white space at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def request_fields(body: Column) -> Column:
    """The fields of a request's body: a JSON object if it begins like one, else a form."""
    text = trimmed(body)
    return F.when(text.startswith("{"), flat_json(text)).otherwise(form_fields(text))


def merged_objects(first: Column, second: Column) -> Column:
    """One JSON object with the members of two, in order. Texts that aren't in braces, and empty ones, add nothing."""
    inner = [trimmed(F.when(t.startswith("{") & t.endswith("}"), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise("")) for t in (trimmed(first), trimmed(second))]
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.when(t != "", t) for t in inner]), F.lit("}"))


def errors(*checks: tuple[Column, str]) -> Column:
    """The messages of all checks that fail, joined by semicolons."""
    return F.concat_ws("; ", *[F.when(~ok, F.lit(message)) for ok, message in checks])
