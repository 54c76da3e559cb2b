"""Instants from timestamps written in many forms.

All forms are one regular expression of alternatives with named groups. A value is matched once;
the named groups are written out as one delimited text and split, so every component costs one
match, on the JVM and inside generated code. Components are checked against the calendar and put
together by integer day arithmetic; only the rules of a named zone are looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Month names of the languages the source apps write, by number.
MONTHS = {
    1: "jan january januar janvier enero ene januari janv jän jänner",
    2: "feb february februar février fevrier febrero februari févr fév",
    3: "mar march märz maerz mars marzo maart mär mrt mrz",
    4: "apr april avril abril avr abr",
    5: "may mai mayo mei",
    6: "jun june juni juin junio",
    7: "jul july juli juillet julio juil",
    8: "aug august août aout agosto augustus ago",
    9: "sep september septembre septiembre sept",
    10: "oct october oktober octobre octubre okt",
    11: "nov november novembre noviembre",
    12: "dec december dezember décembre decembre diciembre dez déc dic",
}

# Minutes east of UTC of zone abbreviations.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "NPT": 345, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570,
    "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}

CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"
#: Seconds since 1970 of the years in which true times lie: 2016 up to and including 2027.
EARLIEST_S, LATEST_S = 1_451_606_400, 1_830_297_600
APPLE_EPOCH_S = 978_307_200

_REGION = r"[A-Za-z]+(?:/[A-Za-z0-9_+\-]+)+|UTC|GMT"
_OFFSET = r"[+\-]\d{2}(?::?\d{2})?"
_MONTH = r"[\p{L}]{3,10}"
_WEEKDAY = r"(?:[\p{L}]{2,10}\.?,? +)?"
_PARTS = ("y", "mo", "mon", "d", "h", "mi", "s", "f", "ap", "off", "abb", "reg", "num")


def _clock(i: int, hours: str = r"\d{1,2}") -> str:
    return rf"(?<h{i}>{hours}):(?<mi{i}>\d{{2}})(?::(?<s{i}>\d{{2}})(?:[.,](?<f{i}>\d{{1,9}})\d*)?)?(?: *(?<ap{i}>[AaPp])\.?[Mm]\b\.?)?"


def _zone(i: int) -> str:
    return rf"(?: *(?<off{i}>{_OFFSET})(?: *[\[(][A-Za-z0-9_/+\-]+[\])])?| *\[?(?<reg{i}>{_REGION})\]?| *(?<abb{i}>[A-Z]{{1,5}}))?"


#: One alternative per way of writing; the number after a group's name is the alternative's.
FORMS = (
    # 2024-05-01, with T or blank, fraction, offset, abbreviation, region, [region]
    rf"(?<y0>\d{{4}})-(?<mo0>\d{{2}})-(?<d0>\d{{2}})(?:[Tt ] *{_clock(0)}{_zone(0)})?",
    # 20240501, 20240501T101500, TZID=region:20240501T101500
    rf"(?:TZID=(?<reg1>{_REGION}):)?(?<y1>\d{{4}})(?<mo1>\d{{2}})(?<d1>\d{{2}})(?:[Tt](?<h1>\d{{2}})(?<mi1>\d{{2}})(?:(?<s1>\d{{2}})(?:[.,](?<f1>\d{{1,9}})\d*)?)?(?:(?<off1>{_OFFSET})|(?<abb1>[A-Z]{{1,5}}))?)?",
    # 01.05.2024 10:15, day first
    rf"(?<d2>\d{{1,2}})\.(?<mo2>\d{{1,2}})\.(?<y2>\d{{4}})(?:,? +{_clock(2)}{_zone(2)})?",
    # 5/1/2024 10:15 AM, month first
    rf"(?<mo3>\d{{1,2}})/(?<d3>\d{{1,2}})/(?<y3>\d{{4}})(?:,? +{_clock(3)}{_zone(3)})?",
    # Wed, 1 May 2024 10:15:00 +0200; 1. Mai 2024 um 10:15; 1 mai 2024 à 10:15; 1 de mayo de 2024 a las 10:15
    rf"{_WEEKDAY}(?<d4>\d{{1,2}})\.?[ \-](?:de +)?(?<mon4>{_MONTH})\.?,?[ \-](?:de +)?(?<y4>\d{{4}})(?:,? +(?:(?:at|um|à|om|a las|kl\.?) +)?{_clock(4)}{_zone(4)})?",
    # May 1, 2024 at 10:15:00 AM
    rf"{_WEEKDAY}(?<mon5>{_MONTH})\.? (?<d5>\d{{1,2}}), *(?<y5>\d{{4}})(?:,? +(?:at +)?{_clock(5)}{_zone(5)})?",
    # Wed May 01 10:15:00 +0200 2024
    rf"{_WEEKDAY}(?<mon6>{_MONTH}) +(?<d6>\d{{1,2}}) +{_clock(6)}{_zone(6)} +(?<y6>\d{{4}})",
    # bare numbers
    r"(?<num7>\d+(?:\.\d+)?(?:[eE]\+?\d{1,2})?)",
)
PATTERN = r"^ *(?:" + "|".join(FORMS) + r") *$"
_REPLACEMENT = "\u0001".join("".join("${" + f"{p}{i}" + "}" for i, form in enumerate(FORMS) if f"(?<{p}{i}>" in form) for p in _PARTS)


def zone_names(spark: SparkSession) -> list[str]:
    """Region names that the JVM's zone rules know."""
    return sorted(str(z) for z in spark._jvm.java.time.ZoneId.getAvailableZoneIds())


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 in the proleptic Gregorian calendar, by integers alone."""
    y = y - F.when(m <= 2, 1).otherwise(0)
    era = F.floor(y / 400)
    yoe = y - era * 400
    doy = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    doe = yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy
    return (era * 146097 + doe - 719468).cast("long")


def number_ms(number: Column) -> Column:
    """Milliseconds since 1970 of a bare number, by the unit and epoch that bring it into the plausible years."""
    whole = F.floor(number).try_cast("long")
    out = None
    for per, epoch in ((1, 0), (10**3, 0), (10**6, 0), (10**9, 0), (1, APPLE_EPOCH_S), (10**9, APPLE_EPOCH_S)):
        low, high = ((x - epoch) * per for x in (EARLIEST_S, LATEST_S))
        ms = F.floor(number * 1000).try_cast("long") if per == 1 else _quotient(whole, per // 1000)
        ms = ms + F.lit(epoch * 1000)
        hit = (number >= F.lit(low)) & (number < F.lit(high))
        out = F.when(hit, ms) if out is None else out.when(hit, ms)
    return out


def _quotient(whole: Column, by: int) -> Column:
    """Whole quotient, through decimals: the dividend may lie beyond the exact range of doubles."""
    return F.floor((whole - F.pmod(whole, F.lit(by))) / F.lit(by).cast("decimal(10,0)")).try_cast("long")


def _blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


def with_utc_ms(df: DataFrame, value: str, zone: str | None, name: str = "utc_ms") -> DataFrame:
    """``df`` with UTC milliseconds since 1970 of column ``value``, null where it denotes no instant.

    A zone or offset inside the value wins over column ``zone``; a local time with neither, an
    impossible date or clock time, years 0 and 1, and an unknown zone give null. A local time that
    occurs twice means the first; one that never occurs moves on by the length of the gap.
    Each step is a projection of its own, so that nothing is computed twice. The row's own columns
    are set aside meanwhile, so their names can't clash; a column called ``name`` is replaced.
    """
    zones = zone_names(df.sparkSession)
    months = F.create_map(*[F.lit(x) for n, names in MONTHS.items() for word in names.split() for x in (word, n)])
    minutes = F.create_map(*[F.lit(x) for k, v in ABBREVIATIONS.items() for x in (k, v)])
    shown = F.col(zone).cast("string") if zone else F.lit(None).cast("string")
    kept = [c for c in df.columns if c != name]
    held = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row"), F.col(value).cast("string").alias("__value"), shown.alias("__fallback"))
    text = F.regexp_replace("__value", "[\\u00A0\\u202F\\u2009\\s]", " ")
    out = held.withColumn("__got", F.split(F.regexp_replace(text, PATTERN, _REPLACEMENT), "\u0001"))

    def part(key: str) -> Column:
        cell = F.get("__got", F.lit(_PARTS.index(key)))
        return F.when((F.size("__got") == len(_PARTS)) & (cell != ""), cell)

    def whole(key: str) -> Column:
        return part(key).try_cast("int")

    fallback = _blank_to_null(F.col("__fallback"))
    out = out.withColumns(
        {
            "__y": whole("y"),
            "__mo": F.coalesce(whole("mo"), F.try_element_at(months, F.lower(part("mon")))),
            "__d": whole("d"),
            "__h": whole("h"),
            "__mi": F.coalesce(whole("mi"), F.lit(0)),
            "__s": F.coalesce(whole("s"), F.lit(0)),
            "__ap": F.lower(part("ap")),
            "__f": F.coalesce(F.rpad(F.substring(part("f"), 1, 3), 3, "0").try_cast("int"), F.lit(0)),
            "__off": F.regexp_replace(part("off"), ":", ""),
            "__abb": part("abb"),
            "__reg": part("reg"),
            "__num": part("num").try_cast("decimal(38,9)"),
        }
    )
    y, mo, d, h, mi, s, half, off = (F.col(f"__{x}") for x in ("y", "mo", "d", "h", "mi", "s", "ap", "off"))
    hour = F.when(half.isNull(), F.coalesce(h, F.lit(0))).when(h.between(1, 12), F.pmod(h, F.lit(12)) + F.when(half == "p", 12).otherwise(0))
    off_h, off_m = F.substring(off, 2, 2).try_cast("int"), F.coalesce(F.substring(off, 4, 2).try_cast("int"), F.lit(0))
    off_min = F.when((off_h <= 15) & (off_m < 60), (off_h * 60 + off_m) * F.when(off.startswith("-"), -1).otherwise(1))
    own = off.isNotNull() | F.col("__abb").isNotNull()
    region = F.coalesce(F.col("__reg"), F.when(~own, fallback))
    out = out.withColumns(
        {
            "__hour": hour,
            "__last": F.when(mo.isin(4, 6, 9, 11), 30).when(mo == 2, F.when(_leap(y), 29).otherwise(28)).otherwise(31),
            "__days": days_from_civil(y, mo, d),
            "__own": own,
            "__fixed": F.coalesce(off_min, F.try_element_at(minutes, F.col("__abb"))),
            "__zone": F.when(region.isin(zones), region),
        }
    )
    valid = (y > 1) & mo.between(1, 12) & (d >= 1) & (d <= F.col("__last")) & F.col("__hour").between(0, 23) & (mi < 60) & (s < 60)
    out = out.withColumn("__local", F.when(valid, F.col("__days") * 86400 + F.col("__hour") * 3600 + mi * 60 + s))
    by_rules = F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds("__local"), F.col("__zone")))
    utc_s = F.when(F.col("__fixed").isNotNull(), F.col("__local") - F.col("__fixed") * 60).when(~F.col("__own"), by_rules)
    ms = F.when(F.col("__num").isNotNull(), number_ms(F.col("__num"))).otherwise(utc_s * 1000 + F.col("__f"))
    return out.withColumn("__ms", ms).select("__row.*", F.col("__ms").alias(name))


def _leap(y: Column) -> Column:
    return (F.pmod(y, F.lit(4)) == 0) & ((F.pmod(y, F.lit(100)) != 0) | (F.pmod(y, F.lit(400)) == 0))


def is_canonical(value: Column) -> Column:
    """Text already in the one unambiguous form."""
    return value.rlike(CANONICAL)
