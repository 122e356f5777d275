"""One pass from a written date to a UTC moment or a plain day, inside the JVM.

All notations are alternatives of one regular expression with named groups. A single
``regexp_replace`` turns a value into its components, which are then range-checked and
assembled by integer day arithmetic. Only a wall time without zone asks the zone database.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names by language, in calendar order.
MONTH_NAMES = {
    "en": "january february march april may june july august september october november december",
    "en_short": "jan feb mar apr may jun jul aug sep oct nov dec",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "de_at": "jänner feber maerz april mai juni juli august september oktober november dezember",
    "de_short": "jan feb mär apr mai jun jul aug sept okt nov dez",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "fr_short": "janv févr mars avr mai juin juil août sept oct nov déc",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "es_short": "ene feb mar abr may jun jul ago set oct nov dic",
    "pt": "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro",
    "pt_short": "jan fev mar abr mai jun jul ago set out nov dez",
    "ru": "января февраля марта апреля мая июня июля августа сентября октября ноября декабря",
    "ru_nominative": "январь февраль март апрель май июнь июль август сентябрь октябрь ноябрь декабрь",
}

# Minutes east of UTC of zone abbreviations that mean one offset.
ZONE_MINUTES = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0,
    "bst": 60, "west": 60, "cet": 60, "mez": 60, "cest": 120, "mesz": 120, "eet": 120, "eest": 180, "msk": 180,
    "gst": 240, "ict": 420, "wib": 420, "hkt": 480, "sgt": 480, "awst": 480, "jst": 540, "kst": 540,
    "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780,
    "est": -300, "edt": -240, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "brt": -180, "art": -180,
}

# Abbreviations whose meaning depends on where the source is.
ZONE_BY_PLACE = {("ist", "Asia/"): 330, ("ist", "Europe/"): 60, ("cst", "Asia/"): 480, ("cst", "America/"): -360}

_BLANK = r"[\s\u0085\u200b\ufeff\p{Z}]"
_DOW = rf"(?:\p{{L}}{{2,10}}\.?,{_BLANK}*|(?:mon|tue|wed|thu|fri|sat|sun)\p{{L}}*\.?{_BLANK}+)?"
_DATE_FORMS = [
    r"(?<ya>\d{4})(?<sa>[-/.])(?<ma>\d{1,2})\k<sa>(?<da>\d{1,2})",
    rf"(?<yc>\d{{4}}){_BLANK}*[年년]{_BLANK}*(?<mc>\d{{1,2}}){_BLANK}*[月월]{_BLANK}*(?<dc>\d{{1,2}}){_BLANK}*[日일]",
    rf"{_DOW}(?<dd>\d{{1,2}})(?:st|nd|rd|th|er|\.|º)?(?:{_BLANK}+|-)(?:(?:de|of){_BLANK}+)?(?<md>\p{{L}}{{3,12}})\.?,?(?:{_BLANK}+|-)(?:(?:de|del){_BLANK}+)?(?<yd>\d{{4}}|\d{{2}})(?!\d|:)(?:{_BLANK}*(?:года|г\.))?",
    rf"{_DOW}(?<me>\p{{L}}{{3,12}})\.?{_BLANK}+(?<de>\d{{1,2}})(?:st|nd|rd|th)?,?{_BLANK}+(?<ye>\d{{4}})",
    r"(?<af>\d{1,2})(?<sf>[/-])(?<bf>\d{1,2})\k<sf>(?<yf>\d{4}|\d{2})(?!\d)",
    r"(?<dg>\d{1,2})\.(?<mg>\d{1,2})\.(?<yg>\d{4}|\d{2})(?!\d)",
]
_ZONE = rf"(?<z>(?:utc|gmt)?{_BLANK}?[+\-−]\d{{1,2}}(?::?\d{{2}})?|\p{{Alpha}}{{1,5}})(?:{_BLANK}*\(\p{{Alpha}}+\))?"
_TIME = (
    rf"(?:(?:t|,?{_BLANK}+(?:at{_BLANK}+)?)(?<h>\d{{1,2}})(?::(?<i>\d{{2}})(?::(?<s>\d{{2}})(?:[.,]\d+)?)?)?"
    rf"(?:{_BLANK}*(?<ap>[ap])\.?{_BLANK}?m\.?)?(?:{_BLANK}*{_ZONE})?)?"
)
_COMPACT = r"(?<yb>\d{4})(?<mb>\d{2})(?<db>\d{2})(?:t?(?<hb>\d{2})(?<ib>\d{2})(?<sb>\d{2})?(?:[.,]\d+)?(?:" + _ZONE.replace("<z>", "<zb>") + ")?)?"
_EPOCH = r"(?<ep>\d{10}|\d{13}|\d{16}|\d{19})"
#: Every notation at once; Java syntax.
DATE_PATTERN = rf"(?iu)^{_BLANK}*(?:{_EPOCH}|(?:{_COMPACT})|(?:{'|'.join(_DATE_FORMS)}){_TIME}){_BLANK}*$"
_COMPONENTS = [
    "${ya}${yb}${yc}${yd}${ye}${yf}${yg}", "${ma}${mb}${mc}${mg}", "${md}${me}", "${da}${db}${dc}${dd}${de}${dg}", "${af}", "${bf}",
    "${h}${hb}", "${i}${ib}", "${s}${sb}", "${ap}", "${z}${zb}", "${ep}",
]
_SEP = "\u0001"


def pin(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``withColumns`` whose expressions are evaluated once, here.

    Catalyst substitutes a projection's expressions into the filters above it, which multiplies a
    chain of derived columns. A one-row generator is a boundary for that and stays in codegen.
    """
    keep = [c for c in df.columns if c not in columns]
    return df.select(*[F.col(f"`{c}`") for c in keep], F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, by integers alone (years from 1 on)."""
    yy = y - F.when(m <= 2, 1).otherwise(0)
    era = F.floor(yy / 400)
    yoe = yy - era * 400
    doy = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    return (era * 146097 + yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy - 719468).cast("long")


def days_in_month(y: Column, m: Column) -> Column:
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def _iso_day(days: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")).cast("string")


def utc_text(secs: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ssZ`` of seconds since the epoch, whatever the session's zone."""
    days = F.floor(secs / 86400)
    rest = F.pmod(secs, F.lit(86400))
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    return F.concat(_iso_day(days), F.lit("T"), two(F.floor(rest / 3600)), F.lit(":"), two(F.floor(rest / 60) % 60), F.lit(":"), two(rest % 60), F.lit("Z"))


def parse_dates(df: DataFrame, column: str, tz: Column | None = None, day_order: Column | None = None, out: str = "ts") -> DataFrame:
    """Add ``{out}_kind``, ``{out}_secs`` and ``{out}_text`` for the written dates in ``column``.

    kind is ``day`` or ``moment``, ``blank`` for NULL or white space, ``format`` if no notation
    fits, ``range`` if the notation fits but no such day or moment exists. secs are seconds since
    the epoch (midnight for a day); secs and text are NULL unless kind is day or moment.

    ``tz`` is the zone of wall times without zone (NULL: UTC); an hour that occurs twice is the
    first, one that is skipped moves on by the skip. ``day_order`` DMY or MDY rules numeric
    slash dates (NULL: DMY); a date impossible in that order is read in the other. Two-digit
    years are 20xx, fractions are dropped, 24:00 is the next midnight, leap seconds do not exist.
    ``tz`` must hold known zone names (see :func:`known_zone`).
    """
    tz = F.lit(None).cast("string") if tz is None else tz
    order = F.lit("DMY") if day_order is None else F.coalesce(day_order, F.lit("DMY"))
    p = f"__{out}_"
    num = lambda c: F.when(c != "", c).try_cast("int")
    months = {name: k % 12 + 1 for names in MONTH_NAMES.values() for k, name in enumerate(names.split())}
    month_map = F.create_map(*[F.lit(x) for kv in months.items() for x in kv])
    zone_map = F.create_map(*[F.lit(x) for kv in ZONE_MINUTES.items() for x in kv])

    blank = F.coalesce(F.col(column), F.lit("")).rlike(rf"^{_BLANK}*$")
    d = df.withColumns({f"{p}tz": tz, f"{p}order": order})
    d = pin(d, {f"{p}blank": blank, f"{p}c": F.when(~blank & F.col(column).rlike(DATE_PATTERN), F.split(F.regexp_replace(column, DATE_PATTERN, _SEP.join(_COMPONENTS)), _SEP))})
    c = [F.col(f"{p}c")[k] for k in range(len(_COMPONENTS))]
    a, b = num(c[4]), num(c[5])
    month_first = F.when(F.col(f"{p}order") == "MDY", ~((a > 12) & (b <= 12))).otherwise((b > 12) & (a <= 12))
    year = num(c[0])
    name = F.lower(c[2])
    blank = F.col(f"{p}blank")
    d = pin(d, {
        f"{p}y": F.when(F.length(c[0]) == 2, year + 2000).otherwise(year),
        f"{p}m": F.when(c[2] != "", month_map[name]).when(c[4] != "", F.when(month_first, a).otherwise(b)).otherwise(num(c[1])),
        f"{p}d": F.when(c[4] != "", F.when(month_first, b).otherwise(a)).otherwise(num(c[3])),
        f"{p}h": F.when(c[9] != "", F.when(num(c[6]).between(1, 12), num(c[6]) % 12 + F.when(F.lower(c[9]) == "p", 12).otherwise(0))).otherwise(num(c[6])),
        f"{p}i": F.when((c[7] == "") & (c[9] != ""), 0).otherwise(num(c[7])),
        f"{p}s": F.coalesce(num(c[8]), F.lit(0)),
        f"{p}z": F.lower(F.regexp_replace(c[10], _BLANK, "")),
        f"{p}ep": c[11],
        f"{p}timed": c[6] != "",
    })
    y, m, dd, h, i, s, z, ep, timed = (F.col(p + k) for k in ("y", "m", "d", "h", "i", "s", "z", "ep", "timed"))
    place = F.coalesce(F.col(f"{p}tz"), F.lit(""))
    digits = F.regexp_replace(F.regexp_replace(z, "^(utc|gmt)(?=.)", ""), "−", "-")
    hhmm = F.regexp_replace(F.substring(digits, 2, 5), ":", "")
    off_h = F.when(F.length(hhmm) <= 2, hhmm).otherwise(F.regexp_extract(hhmm, r"^(\d+)\d\d$", 1)).try_cast("int")
    off_m = F.when(F.length(hhmm) <= 2, F.lit(0)).otherwise(F.regexp_extract(hhmm, r"(\d\d)$", 1).try_cast("int"))
    numeric = F.when((off_h <= 15) & (off_m < 60), F.when(digits.startswith("-"), -1).otherwise(1) * (off_h * 60 + off_m))
    named = zone_map[z]
    for (abbr, where), minutes in ZONE_BY_PLACE.items():
        named = F.when((z == abbr) & place.startswith(where), minutes).otherwise(named)
    named = F.when(z == "cst", F.coalesce(named, F.lit(-360))).when(z == "ist", F.coalesce(named, F.lit(330))).otherwise(named)
    d = pin(d, {f"{p}off": F.when(digits.rlike(r"^[+-]\d"), numeric).otherwise(named), f"{p}zoned": z != ""})
    off, zoned = F.col(f"{p}off"), F.col(f"{p}zoned")

    day_ok = (y >= 1) & m.between(1, 12) & (dd >= 1) & (dd <= days_in_month(y, m))
    time_ok = ~timed | (((h.between(0, 23) & i.between(0, 59)) | ((h == 24) & (i == 0) & (s == 0))) & s.between(0, 59) & (~zoned | off.isNotNull()))
    d = pin(d, {f"{p}days": F.when(F.coalesce(day_ok & time_ok, F.lit(False)), days_from_civil(y, m, dd))})
    local = F.col(f"{p}days") * 86400 + h * 3600 + i * 60 + s
    wall = F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(local), F.coalesce(F.col(f"{p}tz"), F.lit("UTC"))))
    scale = F.when(F.length(ep) == 10, 1).when(F.length(ep) == 13, 1000).when(F.length(ep) == 16, 1_000_000).otherwise(1_000_000_000)
    epoch = F.floor(ep.try_cast("decimal(20,0)") / scale).cast("long")
    is_epoch = F.coalesce(ep != "", F.lit(False))
    d = pin(d, {
        f"{out}_secs": F.when(is_epoch, epoch).when(F.col(f"{p}days").isNull(), None).when(~timed, F.col(f"{p}days") * 86400).when(zoned, local - off * 60).otherwise(wall),
        f"{out}_kind": F.when(blank, "blank").when(F.col(f"{p}c").isNull(), "format").when(is_epoch, "moment").when(F.col(f"{p}days").isNull(), "range").when(timed, "moment").otherwise("day"),
    })
    d = d.withColumn(f"{out}_text", F.when(F.col(f"{out}_kind") == "day", _iso_day(F.floor(F.col(f"{out}_secs") / 86400))).when(F.col(f"{out}_kind") == "moment", utc_text(F.col(f"{out}_secs"))))
    return d.drop(*[x for x in d.columns if x.startswith(p)])


def known_zone(column: Column) -> Column:
    """The zone name if the zone database has it, else NULL (which reads as UTC)."""
    from zoneinfo import available_timezones

    return F.when(F.array_contains(F.array(*[F.lit(z) for z in sorted(available_timezones()) if "/" in z or z in ("UTC", "GMT")]), column), column)
