"""Dates kept as text: the accepted formats and how they are tried.

The replacement of one pattern puts a text in ISO order, and the result is cast.
The cast checks the calendar without raising and catching an error per value.
Only the name of a format needs all parts of a text one by one.

A format is a day format with or without a weekday before it and a time behind
it: minutes, seconds or fractions of them, a half of the day, a zone. Days,
months and hours may have one digit; months are short or full English names,
short ones also with a dot. Years of two digits are the latest ones that do not
lie beyond a last year, 2068 unless told otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted day formats, month before day where both fit.
DAY_FORMATS = (
    "yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd", "MM-dd-yyyy", "MM/dd/yyyy", "MM.dd.yyyy", "dd-MM-yyyy", "dd/MM/yyyy",
    "dd.MM.yyyy", "MM-dd-yy", "MM/dd/yy", "MM.dd.yy", "dd-MM-yy", "dd/MM/yy", "dd.MM.yy", "yyyyMMdd", "MMM d yyyy",
    "MMM d, yyyy", "MMMM d yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "d-MMM-yyyy", "d-MMMM-yyyy", "d MMM yy",
    "d MMMM yy", "d-MMM-yy", "d-MMMM-yy", "MMM yyyy", "MMMM yyyy",
)
LAST_YEAR = 2068

_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november",
           "december")
_NAME = "(?i:" + "|".join(rf"{m[:3]}(?:{m[3:]})?" if m[3:] else m for m in _MONTHS) + r"|sept)\.?"
_WEEKDAY = r"(?i:mon|tue|tues|wed|wednes|thu|thur|thurs|fri|sat|satur|sun)(?i:day)?"
_GROUPS = (
    "weekday", "comma", "packed", "y1", "s1", "m1", "d1", "n2", "s2", "k2", "y2", "name3", "d3", "c3", "y3", "d4", "s4",
    "name4", "y4", "name5", "y5", "gap", "hour", "minute", "second", "fraction", "half", "zone",
)

# One pattern that every text in an accepted format fits.
DATE_LIKE = (
    rf"^(?:({_WEEKDAY})(,? ))?(?:(\d{{8}})|(\d{{4}})([-/.])(\d{{1,2}})\5(\d{{1,2}})"
    rf"|(\d{{1,2}})([-/.])(\d{{1,2}})\9(\d{{4}}|\d{{2}})|({_NAME}) (\d{{1,2}})(,?) (\d{{4}})"
    rf"|(\d{{1,2}})([ -])({_NAME})\17(\d{{4}}|\d{{2}})|({_NAME}) (\d{{4}}))"
    r"(?:([ T])(\d{1,2}):(\d{2})(?::(\d{2})(\.\d{1,9})?)?(?: ?((?i:am|pm)))?(?: ?(Z|(?i:UTC|GMT)|[+-]\d{2}:?\d{2}))?)?\z"
)
_CUT = "\x01"
_ISO_DAY = r"^\d{4}-\d{1,2}-\d{1,2}\z"
_DAY_LEADS = r"^(?:EEE,? )?dd[-/.]"


def is_date_like(c: Column) -> Column:
    """Fits the shape of some format. The length, known at once, and the digits of a year rule many texts out."""
    return F.octet_length(c).between(6, 64) & (c.rlike(_ISO_DAY) | (c.rlike(r"\d\d") & c.rlike(DATE_LIKE)))


class _Parts:
    """The groups of a text that fits the pattern; those that took no part are empty."""

    def __init__(self, groups: Column):
        self.groups = groups

    def __getitem__(self, name: str) -> Column:
        return F.get(self.groups, F.lit(_GROUPS.index(name)))

    def joined(self, *names: str) -> Column:
        return F.concat(*[self[n] for n in names])

    def day_leads(self) -> Column:
        """Two numbers before the year of which the first cannot be a month."""
        return F.coalesce(self["n2"].try_cast("int") > 12, F.lit(False))


def _read(c: Column, read: Callable[[_Parts], Column]) -> Column:
    """An expression over the parts of a date-like text, which are found once; NULL for any other text.

    A text that does not fit the pattern stays as it is, and so is not cut.
    """
    groups = F.split(F.regexp_replace(c, DATE_LIKE, _CUT.join(f"${i + 1}" for i in range(len(_GROUPS)))), _CUT, -1)
    found = F.transform(F.array(groups), lambda g: F.when(F.size(g) == len(_GROUPS), read(_Parts(g))))
    return F.when(F.octet_length(c).between(6, 64) & ~c.contains(_CUT), F.get(found, F.lit(0)))


def _if(text: Column, then: str | Column) -> Column:
    return F.when(text != "", then).otherwise("")


def _format(p: _Parts, day_leads: Column) -> Column:
    name = p.joined("name3", "name4", "name5")
    bare = F.rtrim(name, F.lit("."))
    is_short = (F.length(bare) == 3) | (F.lower(bare) == "sept")
    month = F.concat(F.when(is_short, "MMM").otherwise("MMMM"), F.when(name.endswith("."), ".").otherwise(""))

    def year(text: Column) -> Column:
        return F.when(F.length(text) == 2, "yy").otherwise("yyyy")

    day = (
        F.when(p["packed"] != "", "yyyyMMdd")
        .when(p["y1"] != "", F.concat(F.lit("yyyy"), p["s1"], F.lit("MM"), p["s1"], F.lit("dd")))
        .when(p["n2"] != "", F.concat(
            F.when(day_leads, "dd").otherwise("MM"), p["s2"], F.when(day_leads, "MM").otherwise("dd"), p["s2"], year(p["y2"])))
        .when(p["d3"] != "", F.concat(month, F.lit(" d"), p["c3"], F.lit(" yyyy")))
        .when(p["d4"] != "", F.concat(F.lit("d"), p["s4"], month, p["s4"], year(p["y4"])))
        .otherwise(F.concat(month, F.lit(" yyyy")))
    )
    time = _if(p["gap"], F.concat(
        F.when(p["gap"] == "T", "'T'").otherwise(" "), F.lit("HH:mm"), _if(p["second"], ":ss"), _if(p["fraction"], ".S"),
        _if(p["half"], " a"), _if(p["zone"], "X")))
    return F.concat(_if(p["weekday"], F.concat(F.lit("EEE"), p["comma"])), day, time)


# The texts of DATE_LIKE by the parts that the ISO order needs. Of two numbers before the year the first one may be a
# month (a, b) or not (e, f).
_ISO_LIKE = (
    rf"^(?:{_WEEKDAY},? )?(?:(?<y1>\d{{4}})(?<m1>\d{{2}})(?<d1>\d{{2}})|(?<y2>\d{{4}})(?<s2>[-/.])(?<m2>\d{{1,2}})\k<s2>(?<d2>\d{{1,2}})"
    r"|(?<a>0?\d|1[0-2])(?<s3>[-/.])(?<b>\d{1,2})\k<s3>(?<y3>\d{4}|\d{2})"
    r"|(?<e>1[3-9]|[2-9]\d)(?<s4>[-/.])(?<f>\d{1,2})\k<s4>(?<y4>\d{4}|\d{2})"
    rf"|{_NAME} (?<d5>\d{{1,2}}),? (?<y5>\d{{4}})|(?<d6>\d{{1,2}})(?<s6>[ -]){_NAME}\k<s6>(?<y6>\d{{4}}|\d{{2}})|{_NAME} (?<y7>\d{{4}}))"
    r"(?:(?<time>[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?)(?: ?(?<half>(?i:am|pm)))?(?: ?(?<zone>Z|(?i:UTC|GMT)|[+-]\d{2}:?\d{2}))?)?\z"
)
_NAMED_MONTH = "(?i)" + "|".join(m[:3] for m in _MONTHS)
_YEARS = tuple(f"y{i}" for i in range(1, 8))


def _part(*names: str) -> str:
    return "".join(f"${{{n}}}" for n in names)


def _iso_text(c: Column, day_leads: Column | None) -> Column:
    """A date-like text in ISO order behind a mark and its half of the day; any other text as it is."""
    numbered = F.create_map(*[F.lit(v) for i, m in enumerate(_MONTHS) for v in (m[:3], str(i + 1))])
    named = F.try_element_at(numbered, F.lower(F.regexp_extract(c, _NAMED_MONTH, 0)))
    orders = {"each": ("af", "be"), "month": ("ae", "bf"), "day": ("bf", "ae")}

    def placed(order: str) -> Column:
        month, day = orders[order]
        return F.concat(
            F.lit(_CUT + _part("half", *_YEARS) + "-"),
            F.coalesce(named, F.lit(_part("m1", "m2", *month))),
            F.lit("-" + _part("d1", "d2", *day, "d5", "d6", "time", "zone")))

    order = placed("each") if day_leads is None else F.when(day_leads, placed("day")).otherwise(placed("month"))
    return F.upper(F.regexp_replace(c, F.lit(_ISO_LIKE), order))


def _whole_day(marked: Column) -> Column:
    """Without the mark, and with the hour that the half of the day means; NULL for an hour that it does not have."""
    iso = F.substring(marked, 4, 64)
    hour = F.regexp_extract(iso, r"[ T](\d+):", 1).try_cast("int")
    hour = F.when(hour.between(1, 12), hour % 12 + F.when(F.substring(marked, 2, 1) == "P", 12).otherwise(0))
    in_half = F.regexp_replace(iso, F.lit(r"[ T]\d+:"), F.concat(F.lit(" "), hour.cast("string"), F.lit(":")))
    iso = F.when(F.substring(marked, 3, 1) == "M", in_half).otherwise(F.substring(marked, 2, 64))
    return F.when(marked.startswith(_CUT), iso)


def _completed(iso: Column, last_year: int | Column) -> Column:
    """With the century of a short year, the first day of a month without any, and the seconds before a zone."""
    last = F.lit(last_year) if isinstance(last_year, int) else last_year
    century = F.floor((last - F.left(iso, F.lit(2)).try_cast("int")) / 100)
    whole = F.when(F.substring(iso, 3, 1) == "-", F.concat(century.cast("string"), iso)).otherwise(iso)
    whole = F.regexp_replace(whole, r"^(?<month>\d+-\d+-)(?!\d)", "${month}1")
    return F.regexp_replace(whole, r"(?<time>[ T]\d+:\d\d)(?=[A-Z+-])", "${time}:00")


def parse_any(c: Column, day_leads: Column | None = None, last_year: int | Column = LAST_YEAR) -> Column:
    """Each value in the first format that takes it.

    With the year last the month comes first, unless it cannot be one, or as
    `day_leads` says. A day that is in ISO order already is cast as it stands.
    """
    read = F.transform(F.array(c), lambda t: F.when(
        F.octet_length(t).between(6, 64) & ~t.startswith(_CUT), _iso_text(t, day_leads)))
    read = F.transform(F.transform(read, _whole_day), lambda t: F.coalesce(
        t.try_cast("timestamp"), _completed(t, last_year).try_cast("timestamp")))
    return F.when(c.rlike(_ISO_DAY), c.try_cast("timestamp")).otherwise(F.get(read, F.lit(0)))


def _pattern_of(fmt: str) -> str:
    """The pattern of the texts that have a format."""
    short = "(?i:" + "|".join(m[:3] for m in _MONTHS) + "|sept)"
    parts = {
        "EEE": _WEEKDAY, "yyyyMMdd": r"\d{8}", "yyyy": r"\d{4}", "yy": r"\d{2}", "MMMM": "(?i:" + "|".join(m for m in _MONTHS if m[3:]) + ")",
        "MMM": short, "MM": r"\d{1,2}", "dd": r"\d{1,2}", "d": r"\d{1,2}", "'T'": "T", "HH": r"\d{1,2}", "mm": r"\d{2}",
        "ss": r"\d{2}", ".S": r"\.\d{1,9}", " a": " ?(?i:am|pm)", "X": r" ?(?:Z|(?i:UTC|GMT)|[+-]\d{2}:?\d{2})",
    }
    tokens = "|".join(re.escape(t) for t in sorted(parts, key=len, reverse=True))
    return "^" + re.sub(f"({tokens})|(.)", lambda m: parts[m[1]] if m[1] else re.escape(m[2]), fmt) + r"\z"


def _numbers_of(fmt: str) -> tuple[str, str] | None:
    """For a day of three numbers with a whole year: the pattern of its texts, and what puts them in ISO order."""
    parts = re.fullmatch(r"(yyyy|MM|dd)([-/.]?)(yyyy|MM|dd)\2(yyyy|MM|dd)", fmt)
    if parts is None:
        return None
    order, gap = (parts[1], parts[3], parts[4]), parts[2]
    widths = {"yyyy": r"(\d{4})", "MM": r"(\d{1,2})" if gap else r"(\d{2})", "dd": r"(\d{1,2})" if gap else r"(\d{2})"}
    return (
        "^" + re.escape(gap).join(widths[o] for o in order) + r"\z",
        "-".join(f"${order.index(part) + 1}" for part in ("yyyy", "MM", "dd")),
    )


def parse_with(c: Column, fmt: str) -> Column:
    """Strictly in one format. A day of three numbers needs no more than its pattern."""
    numbers = _numbers_of(fmt)
    if fmt == "yyyy-MM-dd":
        return F.regexp_extract(c, numbers[0], 0).try_cast("timestamp")
    if numbers:
        read = F.transform(F.array(c), lambda t: F.when(
            t.rlike(numbers[0]), F.regexp_replace(t, numbers[0], numbers[1]).try_cast("timestamp")))
        return F.get(read, F.lit(0))
    read = F.transform(F.array(c), lambda t: F.when(
        t.rlike(_pattern_of(fmt)), parse_any(t, F.lit(re.match(_DAY_LEADS, fmt) is not None))))
    return F.get(read, F.lit(0))


def parse_as(c: Column, fmt: Column) -> Column:
    """Strictly in the format that a column names, or in any where it names none."""
    day_leads = fmt.rlike(_DAY_LEADS)
    fits = _read(c, lambda p: _format(p, day_leads) == fmt)
    return F.when(fmt.isNull(), parse_any(c)).when(fits, parse_any(c, day_leads))


_KNOWN_FORMATS = 24


def parse_among(c: Column, fmt: Column, formats: list[str]) -> Column:
    """As `parse_as`, where the formats that the column names are known; each few of them have a pattern of their own."""
    if len(formats) > _KNOWN_FORMATS:
        return parse_as(c, fmt)
    read = F.when(fmt.isNull(), parse_any(c))
    for known in formats:
        read = read.when(fmt == known, parse_with(c, known))
    return read


def first_format(c: Column) -> Column:
    """The first accepted format that takes the value, else NULL."""
    return F.when(parse_any(c).isNotNull(), _read(c, lambda p: _format(p, p.day_leads())))


def shape(c: Column) -> Column:
    """The format of a date-like text, month first; its digits do not matter."""
    return _read(c, lambda p: _format(p, F.lit(False)))


def skeleton(c: Column) -> Column:
    """A date-like text with all digits as 0. Texts of one skeleton have one shape."""
    return F.translate(c, "123456789", "0" * 9)


def written_year(c: Column) -> Column:
    """The year of a date-like text, if it is written in four digits."""
    timed = F.regexp_replace(c, _ISO_LIKE, _part(*_YEARS))
    year = F.when(c.contains(":"), F.when(F.length(timed) == 4, timed)).otherwise(F.regexp_extract(c, r"\d{4}", 0))
    return year.try_cast("int")


def order_matters(c: Column) -> Column:
    """Whether a date-like text has two numbers before its year."""
    return c.rlike(r"^(?:[A-Za-z]+,? )?\d{1,2}[-/.]\d{1,2}[-/.]")


def parse_column(c: Column, fmt: str | None) -> Column:
    """Strictly in one format, or value by value when none was found."""
    return parse_with(c, fmt) if fmt else parse_any(c)


def as_day_text(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))
