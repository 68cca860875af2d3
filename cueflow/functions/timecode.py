"""Media time as integer milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STAMP = r"^\s*(?:(\d+):)?(\d{1,2}):(\d{1,2})(?:[.,](\d*))?\s*$"
LINE = r"^[ \t]*(\d+)[;:](\d{2})[;:](\d{2})(?:[,.](\d+))?[ \t]*-->[ \t]*(\d+)[;:](\d{2})[;:](\d{2})(?:[,.](\d+))?.*$"


def _num(c: Column) -> Column:
    return c.try_cast("bigint")


def parse_ms(c: Column) -> Column:
    """SRT, WebVTT or ASS stamp to ms; NULL if it is none of them.

    A fraction is padded to three digits, so two ASS digits count hundredths.
    """
    g = lambda i: F.regexp_extract(c, STAMP, i)
    hour = F.coalesce(_num(g(1)), F.lit(0))
    frac = _num(F.rpad(g(4), 3, "0"))
    return F.when(c.rlike(STAMP), ((hour * 60 + _num(g(2))) * 60 + _num(g(3))) * 1000 + frac)


def format_ms(c: Column) -> Column:
    """ms to ``HH:MM:SS,mmm``; negative times count as zero, hours are unbounded."""
    t = F.greatest(c.cast("bigint"), F.lit(0).cast("bigint"))
    part = lambda unit, mod: (F.floor(t / unit) % mod).cast("bigint")
    return F.format_string(
        "%02d:%02d:%02d,%03d", F.floor(t / 3600000).cast("bigint"), part(60000, 60), part(1000, 60), t % 1000
    )


def span(start: Column, end: Column) -> Column:
    return F.concat(format_ms(start), F.lit(" --> "), format_ms(end))


def normalise_line(c: Column) -> Column:
    """A time line in ``HH:MM:SS,mmm --> HH:MM:SS,mmm`` form, cue settings dropped."""
    g = lambda i: F.regexp_extract(c, LINE, i)
    hour = lambda i: F.lpad(g(i), F.greatest(F.length(g(i)), F.lit(2)), F.lit("0"))
    ms = lambda i: F.rpad(g(i), 3, "0")
    side = lambda i: F.concat(hour(i), F.lit(":"), g(i + 1), F.lit(":"), g(i + 2), F.lit(","), ms(i + 3))
    return F.when(c.rlike(LINE), F.concat(side(1), F.lit(" --> "), side(5))).otherwise(c)


def hls_offset_ms(header: Column) -> Column:
    """Media offset of an ``X-TIMESTAMP-MAP`` header: MPEGTS (33 bit, 90 kHz) minus LOCAL."""
    body = F.regexp_extract(header, r"(?i)X-TIMESTAMP-MAP\s*=\s*([^\r\n]+)", 1)
    ticks = _num(F.regexp_extract(body, r"(?i)MPEGTS\s*:\s*(\d+)", 1))
    local = F.coalesce(parse_ms(F.regexp_extract(body, r"(?i)LOCAL\s*:\s*([0-9:.]+)", 1)), F.lit(0))
    wrapped = ticks % F.lit(1 << 33)
    return F.coalesce(wrapped / 90.0 - local, F.lit(0.0))


def timer_scale(header: Column) -> Column:
    """Factor of an ASS ``Timer`` percentage; 1.0 if absent, zero or not a number."""
    v = F.regexp_extract(header, r"(?im)^\s*Timer\s*:\s*([0-9]+(?:[.,][0-9]+)?)\s*$", 1)
    pct = F.regexp_replace(v, ",", ".").try_cast("double")
    return F.when(pct > 0, 100.0 / pct).otherwise(1.0)
