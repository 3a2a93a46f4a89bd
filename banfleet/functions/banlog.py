"""Ban log lines: pattern, parsed fields and text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from banfleet.constants import ISO_FORMAT

def _times(what: str, least: int, most: int, between: str) -> str:
    """Pattern of ``least`` to ``most`` repetitions with something between them."""
    return f"{what}(?:{between}{what}){{{least - 1},{most - 1}}}"


# Addresses as the log may have them. Octets may have leading zeros. Around a "::" there may be
# six groups on each side, or seven on one; without it there are eight.
_BELOW_256 = "(?:[01]?[0-9]{1,2}|2(?:[0-4][0-9]|5[0-5]))"
_HEX = "[0-9A-Fa-f]{1,4}"
IPV4 = _times(_BELOW_256, 4, 4, "[.]")
_SOME, _SEVEN = _times(_HEX, 1, 6, ":"), _times(_HEX, 7, 7, ":")
IPV6 = f"(?:{_SOME})?::(?:{_SOME})?|{_SEVEN}::|::{_SEVEN}|{_times(_HEX, 8, 8, ':')}"

_DAY = "[0-9]{4}" + "-[0-9]{2}" * 2
_CLOCK = _times("[0-9]{2}", 3, 3, ":")
#: The words of a ban line, with white space between them: time, logger, process, level, jail,
#: the action and the address.
BAN_LINE = (
    "^"
    + r"\s+".join(
        (
            f"({_DAY} {_CLOCK})(?:,[0-9]+)?",
            r"fail2ban[.]\S+",
            r"\[[0-9]+\]:",
            r"\S+",
            r"\[([A-Za-z0-9_-]+)\]",
            "Ban",
            f"({IPV4}|{IPV6})",
        )
    )
    + r"\s*$"
)


def _text(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def marked(line: Column | str) -> Column:
    """Ban lines become ``time\\njail\\nip``; every other line stays as it is.

    One regex pass yields all three fields. A ban line always changes (the
    result is shorter), so ``marked(x) <> x`` is an exact match test.
    Digits and white space are the ASCII ones.
    """
    return F.regexp_replace(_text(line), F.lit(BAN_LINE), F.lit("$1\n$2\n$3"))


_FIRST_DAY = "0001-01-01 00:00:00"


def _with_marked(lines: DataFrame, line: str) -> DataFrame:
    """Add ``_m``, the marked line.

    Filters on a plain computed column are pushed below it and repeat its regex,
    once per condition. Rows of a generator cannot be pushed through, so the
    regex runs once per line.
    """
    return lines.select("*", F.explode(F.array(marked(line))).alias("_m"))


def _is_ban(line: str) -> Column:
    ts = F.split("_m", "\n").getItem(0).try_cast("timestamp_ntz")
    # the year 0000 is a timestamp to Spark, but no date
    valid = ts >= F.lit(_FIRST_DAY).cast("timestamp_ntz")
    return (F.col("_m") != F.col(line)) & F.coalesce(valid, F.lit(False))


def parse_bans(lines: DataFrame, line: str = "line") -> DataFrame:
    """Replace ``line`` by ``jail, ip, local_ts`` and keep only valid bans.

    ``local_ts`` is the host's wall clock without a zone. Impossible dates and
    the year 0000 give no row. A plain substring test runs before the regex, so
    that most lines of a real log never reach it.
    """
    keep = [c for c in lines.columns if c != line]
    parts = F.split("_m", "\n")
    candidates = lines.where(F.col(line).contains("Ban"))
    return (
        _with_marked(candidates, line)
        .where(_is_ban(line))
        .select(
            *keep,
            parts.getItem(1).alias("jail"),
            parts.getItem(2).alias("ip"),
            parts.getItem(0).try_cast("timestamp_ntz").alias("local_ts"),
        )
    )


def rejected_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """The complement of :func:`parse_bans`, lines left as they are."""
    return _with_marked(lines, line).where(~F.coalesce(_is_ban(line), F.lit(False))).drop("_m")


def local_to_utc(local_ts: Column | str, tz: Column | str) -> Column:
    """Wall clock of a zone to UTC, both without zone.

    A time skipped in spring moves forward, a repeated one in autumn takes the
    first (summer) offset.
    """
    return F.convert_timezone(_text(tz), F.lit("UTC"), _text(local_ts))


def iso_text(ts: Column | str) -> Column:
    """UTC time to ``YYYY-MM-DDTHH:MM:SSZ``; a zoneless time is taken as UTC."""
    return F.date_format(_text(ts).cast("timestamp"), ISO_FORMAT)


def iso_time(text: Column | str) -> Column:
    """ISO text back to a UTC time without zone, NULL if it is not in that form.

    Month, day and clock fields may have one digit. The shape is checked first:
    the datetime parser alone would also take years of other lengths.
    """
    t = _text(text)
    shaped = t.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}T[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}Z$")
    parsed = F.try_to_timestamp(t, F.lit("yyyy-M-d'T'H:m:s'Z'"))
    return F.when(shaped, parsed.cast("timestamp_ntz"))


def report_row(jail: Column | str, ip: Column | str, utc_ts: Column | str) -> Column:
    """One ban as it appears in a report."""
    return F.struct(
        _text(jail).alias("jail"), _text(ip).alias("ip"), iso_text(utc_ts).alias("banned_at")
    )
