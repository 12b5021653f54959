"""Time texts of many spellings as column expressions.

``read_time_text`` adds for a text column

* ``epoch_ms`` - the instant of a bare number (seconds, milliseconds or microseconds) or of a text with an offset
  (also ``Z``, ``UTC+9`` and abbreviations of one meaning),
* ``wall_ms`` - else the wall-clock reading as milliseconds since 1970-01-01 00:00 without any zone,
* ``zone`` - the zone name that stands in the text without an offset,
* ``short`` - the abbreviation of several meanings that stands there instead.

All fields are null for a text that is null, unreadable, or names an impossible date or time.
Readable shapes (surrounding space of any kind is ignored):

* ``2024-03-20T23:01:34.123456+09:00[Asia/Tokyo]`` with ``-`` or ``/`` between the date's parts, ``T`` or space
  before the time, seconds and digits of the second optional,
* ``20241025T191821Z``,
* ``29.10.2022 05:49[:38]`` (day first),
* ``Sat, 27 May 2023 03:02:44 +1000``,
* ``May 19, 2023, 7:41:29 PM UTC+9``,
* bare epoch numbers within a span of time, which also tells the unit.

Digits finer than milliseconds are cut off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The span of bare numbers where none is given: 1980 up to 2070 (UTC), in seconds. A span that ends before a thousand times its
#: beginning tells seconds, milliseconds and microseconds apart.
EPOCH_SPAN = (315_532_800, 3_155_760_000)

#: Minutes east of UTC of the zone abbreviations that have one meaning here.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "UT": 0, "WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "NPT": 345, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "EST": -300, "EDT": -240, "MST": -420, "MDT": -360, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
#: The meanings of those that have several.
AMBIGUOUS = {"BST": (60, 360), "CST": (-360, -300, 480), "CDT": (-300, -240), "IST": (60, 120, 330), "PST": (-480, 480)}

#: Every pattern is rewritten to wall-clock reading|zone.
_CLOCK = r"(\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?)"
_ISO = rf"^(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})[Tt ]+{_CLOCK} *(\S.*)?$"
_COMPACT = r"^(\d{4})(\d{2})(\d{2})[Tt ](\d{2})(\d{2})(\d{2}(?:\.\d+)?) *(\S.*)?$"
_DOTTED = rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),? +{_CLOCK} *(\S.*)?$"
_MAIL = rf"^(?:[A-Za-z]{{3,9}}, *)?(\d{{1,2}}) ([A-Za-z]{{3}})[a-z]*\.? (\d{{4}}) {_CLOCK} *(\S.*)?$"
_MONTH_FIRST = rf"^([A-Za-z]{{3}})[a-z]*\.? (\d{{1,2}}), (\d{{4}}),? {_CLOCK} *([AaPp][Mm])? *(\S.*)?$"
_ABBREVIATED = {k: f"{'-' if v < 0 else '+'}{abs(v) // 60:02d}:{abs(v) % 60:02d}" for k, v in ABBREVIATIONS.items()}


def tidy(text: Column) -> Column:
    """Spaces of every kind as plain ones, and none around the text."""
    plain = F.translate(text, "\t\n\r\u00a0\u202f\u2009\u3000\ufeff\u200b", " " * 9)
    return F.trim(plain)


def _split_reading(t: Column) -> Column:
    """[wall-clock reading, zone text], or null for a text of no known shape."""
    rewritten = (
        F.when(F.substring(t, 5, 1).isin("-", "/"), F.regexp_replace(t, _ISO, "$1-$2-$3 $4|$5"))
        .when(F.upper(F.substring(t, 9, 1)) == "T", F.regexp_replace(t, _COMPACT, "$1-$2-$3 $4:$5:$6|$7"))
        .when((F.substring(t, 3, 1) == ".") | (F.substring(t, 2, 1) == "."), F.regexp_replace(t, _DOTTED, "$3-$2-$1 $4|$5"))
        .when(t.rlike("^(?:[A-Za-z]{3,9}, *)?[0-9]+ [A-Za-z]"), F.regexp_replace(t, _MAIL, "$1 $2 $3 $4|$5"))
        .when(t.rlike("^[A-Za-z]{3,9}[.]? [0-9]"), F.regexp_replace(t, _MONTH_FIRST, "$2 $1 $3 $4 $5|$6"))
    )
    parts = F.split(rewritten, r"\|", -1)
    return F.when(F.size(parts) == 2, parts)


def read_time_text(df: DataFrame, text: Column, name: str, epoch_span: tuple[int, int] = EPOCH_SPAN) -> DataFrame:
    """``df`` with the columns ``{name}_epoch_ms``, ``{name}_wall_ms``, ``{name}_zone`` and ``{name}_short`` described above.

    ``epoch_span`` is where bare numbers may lie, in seconds since 1970 from the first to before the last.

    All are null where the text says nothing usable. The steps are separate projections of plain columns (not of
    structs, which the optimizer would fold into one another), so that every regular expression runs once per row;
    they lean on Spark's own timestamp parser, which keeps the generated code small enough to be compiled.
    """
    base = df.columns
    c = lambda step: F.col(f"{name}_{step}")

    def step(frame: DataFrame, **columns: Column) -> DataFrame:
        return frame.select(*[F.col(f"`{b}`") for b in base], *[v.alias(f"{name}_{k}") for k, v in columns.items()])

    out = step(df, t=tidy(text))
    out = step(out, t=c("t"), p=_split_reading(c("t")))
    out = step(out, n=F.when(c("p").isNull() & c("t").rlike("^[0-9]{1,17}$"), c("t").cast("bigint")), w=c("p")[0], z=F.trim(c("p")[1]))
    w, z = c("w"), c("z")
    numeric = F.regexp_extract(z, r"^(?:UTC|GMT)? *([+-][0-9]{1,2}(?::?[0-9]{2})?(?::?[0-9]{2})?) *(?:[\[(].*)?$", 1)
    short = (F.length(w) <= 16) & w.rlike("^[^:]*:[0-9]{2}$")
    out = step(out, n=c("n"), w=F.when(short, F.concat(w, F.lit(":00"))).otherwise(w), z=z, o=F.when(z != "", numeric))
    n, w, z, o = (c(x) for x in "nwzo")
    names = F.create_map(*[F.lit(x) for kv in _ABBREVIATED.items() for x in kv])
    bare = F.upper(F.translate(z, "[]()", ""))
    offset = F.when(z == "", None).when(o != "", o).when(F.length(z) <= 6, F.try_element_at(names, bare)).when(z.rlike(r"^[Zz] *[\[(]"), "+00:00")
    short = F.when((z != "") & (o == "") & (F.length(z) <= 6) & bare.isin(*AMBIGUOUS), bare)
    out = step(out, n=n, w=w, z=z, o=offset, short=short)
    zone = F.when(o.isNull() & F.contains(z, F.lit("/")), F.translate(z, "[]()", ""))
    at = F.coalesce(o, F.lit("Z"))
    # A reading with a dash after the year is plain; the others hold a month's name.
    stamp = (
        F.when(F.substring(w, 5, 1) == "-", F.concat(w, at).try_cast("timestamp"))
        .when(w.rlike("[AaPp][Mm]$"), F.try_to_timestamp(F.concat(_month_cased(w), F.lit(" "), _padded(at)), F.lit("d MMM yyyy h:mm:ss a XXX")))
        .otherwise(F.try_to_timestamp(F.concat(_month_cased(F.rtrim(w)), F.lit(" "), _padded(at)), F.lit("d MMM yyyy H:mm:ss XXX")))
    )
    out = step(out, n=n, z=z, o=o, zone=zone, short=c("short"), s=stamp)
    readable = (z == "") | o.isNotNull() | c("zone").isNotNull() | c("short").isNotNull()
    out = step(out, n=n, o=o, zone=c("zone"), short=c("short"), ms=F.when(readable, F.unix_millis(c("s"))))
    inside = lambda scale: (n >= epoch_span[0] * scale) & (n < epoch_span[1] * scale)
    bare_ms = F.when(inside(1), n * 1000).when(inside(1000), n).when(inside(1_000_000), F.floor(n / F.lit(1000)))
    ms = c("ms")
    return step(out, epoch_ms=F.coalesce(bare_ms, F.when(o.isNotNull(), ms)), wall_ms=F.when(o.isNull(), ms), zone=c("zone"), short=c("short"))


def _month_cased(wall: Column) -> Column:
    """Month names as the formatter wants them; the rest as it is, with a half of the day in capitals."""
    return F.regexp_replace(F.initcap(wall), "(?<= [AP])m$", "M")


def _padded(offset: Column) -> Column:
    """``+9``, ``+0900`` and ``Z`` as ``+09:00``."""
    long = F.regexp_replace(offset, "^([+-])([0-9])(?![0-9])", "$10$2")
    colon = F.regexp_replace(long, "^([+-][0-9]{2}):?([0-9]{2})?$", "$1:$2")
    return F.when(offset == "Z", "+00:00").when(colon.endswith(":"), F.concat(colon, F.lit("00"))).otherwise(colon)
