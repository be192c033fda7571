"""Scalar functions as Column expressions: they stay inside generated code, none of them is a Python UDF."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of public formats, and names that stored graphs use.
#: White space as JavaScript and Unicode know it; Java's \s leaves out all but the ASCII part.
WS = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
UUID7 = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-7[0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$"
PROJECT = r"^[a-z0-9][a-z0-9._-]*$"
ROOTS = {"CollectiveKnowledge": "System", "Coding": "Project", "DynArch": "Project", "Timeline": "Project", "Normalisa": "Project"}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- text


def normalize_text(text: Column | str) -> Column:
    """Runs of white space, Unicode's included, as one space; none at either end."""
    return F.trim(F.regexp_replace(col(text), WS, " "))


def tokens(text: Column | str) -> Column:
    """Distinct lower-case tokens between white space; of an empty text the one empty token."""
    return F.array_distinct(F.split(F.lower(F.coalesce(col(text), F.lit(""))), WS))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Shared tokens over all tokens of two texts; texts are split once each."""
    return jaccard_sets(tokens(a), tokens(b))


def jaccard_sets(x: Column, y: Column) -> Column:
    shared = F.size(F.array_intersect(x, y))
    return shared / (F.size(x) + F.size(y) - shared)


def derive_name(text: Column | str, most: int = 120, otherwise: str = "(empty)") -> Column:
    """The first line that is not blank, trimmed, at most ``most`` characters."""
    lines = F.filter(F.transform(F.split(F.coalesce(col(text), F.lit("")), "\n"), normalize_ends), lambda x: x != "")
    return F.coalesce(F.substring(F.get(lines, F.lit(0)), 1, most), F.lit(otherwise))


def normalize_ends(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}|{WS}$", "")


def truncate(text: Column | str, most: int = 200) -> Column:
    """The first ``most`` characters; of a missing text none."""
    return F.substring(F.coalesce(col(text), F.lit("")), 1, most)


def contains_ci(text: Column | str, wanted: str) -> Column:
    """Literal, case-insensitive; null text holds nothing."""
    return F.coalesce(F.contains(F.lower(col(text)), F.lit(wanted.lower())), F.lit(False))


# ---------------------------------------------------------------- vectors


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine over the common prefix of two vectors, in double; 0 where either norm is 0."""
    a, b = col(a), col(b)
    n = F.least(F.size(a), F.size(b))
    x, y = (F.transform(F.slice(v, F.lit(1), n), lambda e: e.cast("double")) for v in (a, b))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e)
    dot, nx, ny = total(F.zip_with(x, y, lambda p, q: p * q)), total(F.transform(x, lambda e: e * e)), total(F.transform(y, lambda e: e * e))
    return F.when((n > 0) & (nx > 0) & (ny > 0), dot / F.sqrt(nx * ny)).otherwise(F.lit(0.0))


# ---------------------------------------------------------------- time


def stamp_ms(text: Column | str) -> Column:
    """Milliseconds of an ISO time; 0 for a missing or unreadable one."""
    return F.coalesce(F.unix_millis(F.try_to_timestamp(col(text))), F.lit(0))


def first_stamp(*texts: Column | str) -> Column:
    """The first of several times that is readable and not the epoch, in milliseconds; else 0."""
    return F.coalesce(*(F.nullif(stamp_ms(t), F.lit(0)) for t in texts), F.lit(0))


def iso(time: Column | str) -> Column:
    return F.date_format(col(time), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def is_active(as_of: str, valid_until: Column | str = "validUntil") -> Column:
    """True without an end, or with one strictly after as_of; an unreadable end makes a row inactive."""
    until = col(valid_until)
    return until.isNull() | F.coalesce(F.try_to_timestamp(until) > F.to_timestamp(F.lit(as_of)), F.lit(False))


# ---------------------------------------------------------------- identifiers


def is_uuid7(text: Column | str) -> Column:
    return F.coalesce(col(text).rlike(UUID7), F.lit(False))


def mint_uuid7(time: Column | str, *key: Column | str) -> Column:
    """A UUIDv7 of a time and a natural key: equal inputs give equal ids, so reruns agree."""
    h = F.sha2(F.concat_ws("\u0000", *(col(k).cast("string") for k in key)), 256)
    ms = F.lpad(F.lower(F.hex(F.unix_millis(col(time).cast("timestamp")))), 12, "0")
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(h, 4, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat_ws(
        "-",
        F.substring(ms, 1, 8),
        F.substring(ms, 9, 4),
        F.concat(F.lit("7"), F.substring(h, 1, 3)),
        F.concat(variant, F.substring(h, 5, 3)),
        F.substring(h, 8, 12),
    )


def is_project(name: Column | str) -> Column:
    name = col(name)
    return F.coalesce(name.rlike(PROJECT) & (F.length(name) <= 64) & (name != "default"), F.lit(False))


def is_hierarchy_root(name: Column | str, roots: Sequence[str] = tuple(ROOTS)) -> Column:
    return F.coalesce(col(name).isin(*roots), F.lit(False))


def root_class(name: Column | str) -> Column:
    """The class that a hierarchy root has whatever a classifier says; null of other names."""
    return F.create_map(*(F.lit(x) for pair in ROOTS.items() for x in pair))[col(name)]


def relation_key(source: Column | str, kind: Column | str, target: Column | str) -> Column:
    return F.concat_ws("\u0000", col(source), F.coalesce(col(kind), F.lit("")), col(target))


def bucket(domain: Column | str, known: Sequence[str], otherwise: str = "general") -> Column:
    """The export bucket of a row: its domain if that is known."""
    return F.when(col(domain).isin(*known), col(domain)).otherwise(F.lit(otherwise))


# ---------------------------------------------------------------- JSON bags


def bag(json: Column | str, field: str) -> Column:
    """A field of a JSON object as text; null where the text is no JSON or the field is missing."""
    return F.get_json_object(col(json), f"$.{field}")


def lenient_object(json: Column | str) -> Column:
    """A JSON object as a map of texts; an empty one for anything else."""
    parsed = F.from_json(col(json), "map<string,string>", {"mode": "PERMISSIVE"})
    return F.coalesce(parsed, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def lenient_strings(json: Column | str) -> Column:
    """The strings of a JSON array; an empty array for anything else."""
    items = F.coalesce(F.from_json(col(json), "array<variant>"), F.array().cast("array<variant>"))
    texts = F.transform(items, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    return F.filter(texts, lambda x: x.isNotNull())


def overlay(old: Column, new: Column) -> Column:
    """Two maps as one; the new one wins where both have a key."""
    kept = F.map_filter(F.coalesce(old, _no_map()), lambda k, _: ~F.array_contains(F.map_keys(F.coalesce(new, _no_map())), k))
    return F.map_concat(kept, F.coalesce(new, _no_map()))


def _no_map() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))


# ---------------------------------------------------------------- driver-side helpers


def answer_json(text: str) -> object | None:
    """The JSON in a model's answer: a fence around all of it, any fence, the outermost braces, or the text itself."""
    import json

    tries = [*re.findall(r"^\s*```(?:json)?\s*(.*?)```\s*$", text, re.S), *re.findall(r"```(?:json)?\s*(.*?)```", text, re.S)]
    if "{" in text and "}" in text:
        tries.append(text[text.index("{") : text.rindex("}") + 1])
    for t in [*tries, text]:
        try:
            return json.loads(t)
        except ValueError:
            continue
    return None


def parse_int(text: str | int | None) -> int | None:
    """The integer that a request parameter begins with; None where it begins with none."""
    found = re.match(r"\s*([+-]?\d+)", str(text)) if text is not None else None
    return int(found[1]) if found else None
