"""Agent inventory: keys, versions, settings, row by row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from banfleet import constants as C


def key_is_valid(key: Column) -> Column:
    return key.rlike(C.API_KEY_PATTERN)


def mask_key(key: Column) -> Column:
    return F.concat(F.substring(key, 1, 14), F.lit("..."), F.right(key, F.lit(4)))


def version_number(text: Column) -> Column:
    """First ``a.b`` or ``a.b.c`` in a text, empty if there is none."""
    return F.regexp_extract(text, r"([0-9]+\.[0-9]+(?:\.[0-9]+)?)", 1)


def version_parts(text: Column) -> tuple[Column, Column]:
    """Major and minor number as integers, so that 0.9 sorts before 0.10."""
    parts = F.split(version_number(text), r"\.")
    return (
        F.get(parts, F.lit(0)).try_cast("int"),
        F.get(parts, F.lit(1)).try_cast("int"),
    )


def version_too_old(text: Column, minimum: tuple[int, int] = C.MIN_VERSION) -> Column:
    """Below the minimum; a text without a version is not held against the host."""
    major, minor = version_parts(text)
    older = (major < minimum[0]) | ((major == minimum[0]) & (minor < minimum[1]))
    return F.coalesce(older, F.lit(False))


#: White space that counts as none around a word.
_WHITE = " \t\n\x0b\x0c\r"


def text_to_bool(text: Column, default: bool) -> Column:
    """Blank and absent texts give the default; white space of any kind around a word is ignored."""
    word = F.nullif(F.btrim(text, F.lit(_WHITE)), F.lit(""))
    return F.coalesce(F.lower(word).isin(*C.TRUE_WORDS), F.lit(default))


def usable_log_target(value: Column) -> Column:
    """Unset, ``AUTO`` or an absolute path."""
    v = F.coalesce(value, F.lit(""))
    return (v == "") | (v == "AUTO") | v.startswith("/")


def sidecar_digest(text: Column) -> Column:
    """First token of the first line of a checksum file."""
    first_line = F.substring_index(text, "\n", 1)
    return F.split(F.trim(first_line), r"\s+").getItem(0)
