"""Problem 2: mixed timestamp notations and zones, normalised to one unambiguous form.

Values are parsed by JVM-side patterns into a local time and what the value says about its zone. Local times
are then matched as-of with zone-offset intervals exploded by local year: two matching intervals mean an
ambiguous time (the earlier instant is taken), none a skipped one (the offset before the jump counts), one
gives the offset directly. The interval table has one row per zone, offset period and year; its size follows
from the number of zones (a bounded vocabulary), never from the data.

Defined cases: null, missing, unreadable or impossible values are not listed, nor are local times whose area
has no zone; a record that comes several times gives one row, the instant most of its notations agree on,
times of day before dates, the finer before the coarser; empty inputs give no rows; areas are compared
without case and surrounding white space; years from 1 to 9999 are read, those past the interval table by its
last rules; a zone name counts if the zone list has it, however many other tails the values end in.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError, available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
    "january": 1, "february": 2, "march": 3, "april": 4, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "janvier": 1, "février": 2, "fevrier": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "août": 8, "aout": 8, "septembre": 9, "octobre": 10, "novembre": 11, "décembre": 12, "decembre": 12,
}
#: Minutes east of UTC (fixed values).
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "IST": 330, "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240,
    "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}

_ZONE = r"(?:\s*(Z|UTC|GMT|[A-Z]{3,4}|[+-]\d{2}:?\d{2}|[A-Za-z]+(?:/[A-Za-z_+\-0-9]+)+))?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?(?:\s*([AaPp])\.?[Mm]\.?(?![A-Za-z]))?"
#: (pattern, order of its groups); y year, m month, n month's name, a/b a numeric day and month in the source's order,
#: d day, H M S clock, p half of the day, z zone.
NOTATIONS: list[tuple[str, str]] = [
    (rf"(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})(?:[T ]\s*{_CLOCK}{_ZONE})?", "ymdHMSpz"),
    (rf"(\d{{4}})(\d{{2}})(\d{{2}})(?:[T ](\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,]\d+)?{_ZONE})?", "ymdHMSz"),
    (rf"(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}|\d{{2}})(?:,?[T ]\s*{_CLOCK}{_ZONE})?", "abyHMSpz"),
    (rf"(?:\p{{L}}+,\s*)?(\d{{1,2}})[- ](\p{{L}}+)\.?,?[- ](\d{{4}}|\d{{2}})(?:,?[T ]\s*{_CLOCK}{_ZONE})?", "dnyHMSpz"),
    (rf"(\p{{L}}+)\.?\s+(\d{{1,2}}),?\s+(\d{{4}})(?:,?[T ]\s*{_CLOCK}{_ZONE})?", "ndyHMSpz"),
    (r"(\d{2}):?(\d{2})\s*(?:hrs|hours|h)\.?,?\s+(\d{1,2})\s+(\p{L}+)\s+(\d{4})", "HMdny"),
    (r"le\s+(\d{1,2})(?:er)?\s+(\p{L}+)\s+(\d{4})(?:\s+à\s+(\d{1,2})\s*h(?:\s*(\d{2}))?)?", "dnyHM"),
]


#: Years with intervals of their own. Local mean time holds in every zone before them; after them the last rule goes on,
#: so a later year is matched as one of the last 28 with the same calendar.
FIRST_YEAR, LAST_YEAR = 1800, 2099


def _matched_year(year: Column) -> Column:
    """The year whose intervals serve ``year``."""
    leap = lambda y: y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)
    same = {date(y, 1, 1).isoweekday() + 10 * leap(y): y for y in range(LAST_YEAR - 27, LAST_YEAR + 1)}
    first = F.make_date(year, F.lit(1), F.lit(1))
    calendar = (F.weekday(first) + 1) + F.when((year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0)), 10).otherwise(0)
    late = F.element_at(_literal_map(same), calendar)
    return F.when(year > LAST_YEAR, late).when(year <= FIRST_YEAR, F.lit(FIRST_YEAR + 1)).otherwise(year)


def zone_intervals(spark: SparkSession, zones: list[str], first: int = FIRST_YEAR, last: int = LAST_YEAR + 1) -> DataFrame:
    """(zone_name, year, local_start, local_end, held_until, offset) in local seconds; held_until closes the gap of a jump."""
    rows = []
    for name in sorted(set(zones)):
        try:
            zone = ZoneInfo(name)
        except (ZoneInfoNotFoundError, ValueError):
            continue
        begin, end = int(datetime(first, 1, 1, tzinfo=timezone.utc).timestamp()), int(datetime(last, 1, 1, tzinfo=timezone.utc).timestamp())

        def offset(t: int) -> int:
            return int((datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=t)).astimezone(zone).utcoffset().total_seconds())

        cuts, t, step = [(begin, offset(begin))], begin, 7 * 86400
        while t < end:
            a, b = t, min(t + step, end)
            if offset(a) != offset(b):
                while b - a > 1:
                    mid = (a + b) // 2
                    a, b = (mid, b) if offset(mid) == offset(t) else (a, mid)
                cuts.append((b, offset(b)))
                t = b
            else:
                t = b
        for k, (start, off) in enumerate(cuts):
            stop = cuts[k + 1][0] if k + 1 < len(cuts) else end
            local_start, local_end = start + off, stop + off
            held = max(local_end, stop + cuts[k + 1][1]) if k + 1 < len(cuts) else local_end
            y0, y1 = (datetime(1970, 1, 1) + timedelta(seconds=s) for s in (local_start, held))
            rows += [(name, y, local_start, local_end, held, off) for y in range(y0.year, y1.year + 1)]
    return spark.createDataFrame(rows, "zone_name string, year int, local_start long, local_end long, held_until long, offset int")


def _literal_map(values: dict[str, int]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


#: Order of the parts in the one form that every notation is rewritten to.
_PARTS = "ymnabdHMSpz"


def _rewritten(value: Column) -> Column:
    """``|y|m|n|a|b|d|H|M|S|p|z`` of a readable notation (missing parts empty), other values as they are."""
    for pattern, order in NOTATIONS:
        value = F.regexp_replace(value, rf"^(?:{pattern})$", "".join("|" + (f"${order.index(x) + 1}" if x in order else "") for x in _PARTS))
    return value


def _date(y: Column, m: Column, d: Column) -> Column:
    """The date, or null where there is none (make_date raises under ANSI)."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")


def parse_times(df: DataFrame, value: str, month_first: Column) -> DataFrame:
    """Adds t_day (date), t_local (local seconds since 1970, null without a time of day), t_zone, t_unix; all null if unreadable."""
    text = lambda x: F.nullif(F.get(F.col("__parts"), F.lit(1 + _PARTS.index(x))), F.lit(""))
    number = lambda x: text(x).cast("int")
    month = F.coalesce(F.element_at(_literal_map(MONTHS), F.lower(text("n"))), number("m"), F.when(month_first, number("a")).otherwise(number("b")))
    day = F.coalesce(number("d"), F.when(month_first, number("b")).otherwise(number("a")))
    year = number("y") + F.when(F.length(text("y")) == 2, 2000).otherwise(0)
    half = F.lower(text("p"))
    hour = F.when(half.isNull(), number("H")).when(number("H").between(1, 12), number("H") % 12 + F.when(half == "p", 12).otherwise(0)).otherwise(99)
    bare = F.col("__value").rlike(r"^(?:\d{10}|\d{13})$")
    unix = F.when(F.length("__value") == 10, F.col("__value").cast("long")).otherwise(F.floor(F.try_divide(F.col("__value").cast("long"), F.lit(1000))))
    clock = F.col("__hour").isNull() | ((F.col("__hour") <= 23) & (F.col("__minute") <= 59) & (F.col("__second") <= 59))
    return (
        df.withColumn("__value", F.trim(F.regexp_replace(F.col(value), r"[\s\u00a0]+", " ")))
        .withColumn("t_unix", F.when(bare, unix))
        .withColumn("__parts", F.split(_rewritten(F.col("__value")), r"\|"))
        .withColumns({"__year": year, "__month": month, "__day": day, "__hour": hour, "__minute": F.coalesce(number("M"), F.lit(0)), "__second": F.coalesce(number("S"), F.lit(0)), "t_zone": text("z")})
        .withColumn("t_day", F.when(clock, _date(F.col("__year"), F.col("__month"), F.col("__day"))))
        .withColumn("t_local", F.unix_date("t_day").cast("long") * 86400 + F.col("__hour") * 3600 + F.col("__minute") * 60 + F.col("__second"))
        .drop("__value", "__parts", "__year", "__month", "__day", "__hour", "__minute", "__second")
    )


def _offset_in_text(zone: Column) -> Column:
    """Seconds east of UTC that an offset or abbreviation names; null for zone names and what isn't known."""
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(zone, r"[^0-9]", "")
    hours, minutes = F.substring(digits, 1, 2).cast("int"), F.substring(digits, 3, 2).cast("int")
    numeric = F.when((hours <= 18) & (minutes <= 59), sign * (hours * 3600 + minutes * 60))
    return F.when(zone.rlike(r"^[+-]"), numeric).otherwise(F.element_at(_literal_map(ABBREVIATIONS), zone) * 60)


def normalise(records: DataFrame, zones: DataFrame) -> DataFrame:
    """``records``: source, record_no, value, area. ``zones``: source, area, zone_name. Adds normal_time and status.

    status: ``unix``, ``date``, ``zoned``, ``unique``, ``ambiguous``, ``skipped``, ``no_zone``, ``unknown_zone`` or ``unreadable``.
    """
    spark = records.sparkSession
    key = F.lower(F.trim("source")), F.lower(F.trim("area"))
    areas = zones.select(key[0].alias("z_source"), key[1].alias("z_area"), F.col("zone_name").alias("area_zone")).dropDuplicates(["z_source", "z_area"])
    rows = records.select("source", "record_no", "value", "area").distinct()
    known = [r[0] for r in areas.select("area_zone").filter("area_zone is not null").distinct().collect()]  # a vocabulary of IANA zones
    told = F.regexp_extract("value", r"([A-Za-z]+(?:/[A-Za-z_+\-0-9]+)+)\s*$", 1)
    # only names of the zone list reach the driver: about 600, however many tails the values have
    listed = spark.createDataFrame([(z,) for z in sorted(available_timezones())], "z string")
    told = [r[0] for r in rows.select(told.alias("z")).join(F.broadcast(listed), "z", "left_semi").distinct().collect()]
    intervals = zone_intervals(spark, [*known, *told]).withColumnRenamed("zone_name", "i_zone")
    parsed = parse_times(rows, "value", F.lower(F.trim("source")) == "phmsa")
    parsed = parsed.join(areas, (F.lower(F.trim("source")) == F.col("z_source")) & (F.lower(F.trim("area")) == F.col("z_area")), "left").drop("z_source", "z_area")
    named = F.col("t_zone").contains("/")
    open_offset = F.col("t_unix").isNull() & F.col("t_local").isNotNull() & F.col("t_offset").isNull()
    parsed = parsed.withColumn("t_offset", _offset_in_text(F.col("t_zone"))).withColumn("t_name", F.when(open_offset, F.when(F.col("t_zone").isNull(), F.col("area_zone")).when(named, F.col("t_zone"))))
    # the as-of match: equal zone and local year, then the interval bounds; two intervals at most hold one local time
    start = lambda y: F.unix_date(F.make_date(y, F.lit(1), F.lit(1))).cast("long") * 86400
    at_year = parsed.withColumn("t_year", _matched_year(F.year("t_day")))
    parsed = at_year.withColumn("t_match", F.col("t_local") - start(F.year("t_day")) + start(F.col("t_year")))
    hit = (F.col("t_name") == F.col("i_zone")) & (F.col("t_year") == F.col("year")) & (F.col("t_match") >= F.col("local_start")) & (F.col("t_match") < F.col("held_until"))
    inside = F.col("t_match") < F.col("local_end")
    one = lambda c: F.first(c, ignorenulls=True).alias(c)
    matched = (
        parsed.join(intervals, hit, "left")
        .groupBy("source", "record_no", "value", "area")
        .agg(*(one(c) for c in ("t_day", "t_local", "t_unix", "t_zone", "t_offset", "t_name")), F.sum(inside.cast("int")).alias("hits"), F.max(F.when(inside, F.col("offset"))).alias("inside"), F.max_by("offset", "local_start").alias("before"))
    )
    offset = F.coalesce("t_offset", "inside", "before")
    instant = F.coalesce("t_unix", F.col("t_local") - offset)
    status = (
        F.when(F.col("t_unix").isNotNull(), "unix").when(F.col("t_day").isNull(), "unreadable").when(F.col("t_local").isNull(), "date").when(F.col("t_offset").isNotNull(), "zoned")
        .when(F.col("before").isNull(), F.when(F.col("t_zone").isNull() & F.col("t_name").isNull(), "no_zone").otherwise("unknown_zone"))
        .when(F.col("hits") > 1, "ambiguous").when(F.col("hits") == 1, "unique").otherwise("skipped")
    )
    when_timed = F.date_format(F.timestamp_seconds(instant), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return matched.select("source", "record_no", "value", "area", status.alias("status"), F.coalesce(when_timed, F.when(F.col("t_local").isNull(), F.date_format("t_day", "yyyy-MM-dd"))).alias("normal_time"))


def one_per_record(normalised: DataFrame) -> DataFrame:
    """One row per record: the readable form most notations agree on, a time before a date, the finer before the coarser."""
    votes = normalised.filter("normal_time is not null and record_no is not null").groupBy("source", "record_no", "normal_time").agg(F.count("*").alias("n"))
    fine = F.struct((F.length("normal_time") > 10).alias("timed"), F.col("n"), (~F.col("normal_time").endswith(":00Z")).alias("seconds"), F.col("normal_time"))
    return votes.groupBy("source", "record_no").agg(F.max_by("normal_time", fine).alias("normal_time"))
