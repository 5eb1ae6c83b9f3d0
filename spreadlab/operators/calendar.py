"""Calendar, cyclical and holiday features as plain expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadlab.functions.columns import col, cyclic
from spreadlab.session import join_measured

# Fixed-date holidays (name, month, day, first year, moved to a weekday when on a weekend).
FIXED_DATES = [
    ("New Year's Day", 1, 1, 1871, True),
    ("Confederate Memorial Day", 1, 19, 1931, False),
    ("Texas Independence Day", 3, 2, 1874, False),
    ("Cesar Chavez Day", 3, 31, 2000, False),
    ("San Jacinto Day", 4, 21, 1875, False),
    ("Emancipation Day In Texas", 6, 19, 1980, False),
    ("Juneteenth National Independence Day", 6, 19, 2021, True),
    ("Independence Day", 7, 4, 1871, True),
    ("Lyndon Baines Johnson Day", 8, 27, 1973, False),
    ("Veterans Day", 11, 11, 1938, True),
    ("Christmas Eve", 12, 24, 1981, False),
    ("Christmas Day", 12, 25, 1871, True),
    ("Day After Christmas", 12, 26, 1981, False),
]
# Weekday rules (name, month, first and last day of the month it can fall on, weekday with Monday 0).
WEEKDAY_RULES = [
    ("Martin Luther King Jr. Day", 1, 15, 21, 0),
    ("Washington's Birthday", 2, 15, 21, 0),
    ("Memorial Day", 5, 25, 31, 0),
    ("Labor Day", 9, 1, 7, 0),
    ("Columbus Day", 10, 8, 14, 0),
    ("Thanksgiving Day", 11, 22, 28, 3),
    ("Friday After Thanksgiving", 11, 23, 29, 4),
]
# Name fragments that mark a major holiday.
MAJOR_NAMES = ["Christmas", "New Year", "Thanksgiving", "Independence Day", "Memorial Day", "Labor Day"]


def easter_sunday(year: Column) -> Column:
    """Gregorian Easter date by the anonymous computus."""
    idiv = lambda a, n: F.floor(a / F.lit(n))
    a, b, c = year % 19, idiv(year, 100), year % 100
    d, e = idiv(b, 4), b % 4
    f = idiv(b + 8, 25)
    g = idiv(b - f + 1, 3)
    h = (a * 19 + b - d - g + 15) % 30
    i, k = idiv(c, 4), c % 4
    m = (e * 2 + i * 2 - h - k + 32) % 7
    n = idiv(a + h * 11 + m * 22, 451)
    month = idiv(h + m - n * 7 + 114, 31)
    day = (h + m - n * 7 + 114) % 31 + 1
    return F.make_date(year, month.cast("int"), day.cast("int"))


def holiday_names(date: str | Column) -> Column:
    """Names of the US and Texas holidays on a date, joined by "; "; null on ordinary days."""
    d = col(date).cast("date")
    y, m, dom, dow = F.year(d), F.month(d), F.dayofmonth(d), F.weekday(d)
    names = []
    for name, month, day, since, moves in FIXED_DATES:
        names.append(F.when((m == month) & (dom == day) & (y >= since), name))
        if moves:
            near_fri, near_mon = F.date_add(d, 1), F.date_sub(d, 1)
            on = lambda x: (F.month(x) == month) & (F.dayofmonth(x) == day) & (F.year(x) >= since)
            names.append(F.when(((dow == 4) & on(near_fri)) | ((dow == 0) & on(near_mon)), f"{name} (observed)"))
    for name, month, lo, hi, wd in WEEKDAY_RULES:
        names.append(F.when((m == month) & dom.between(lo, hi) & (dow == wd), name))
    names.append(F.when(d == F.date_sub(easter_sunday(y), 2), "Good Friday"))
    joined = F.concat_ws("; ", *names)
    return F.when(joined != "", joined)


def is_holiday(date: str | Column) -> Column:
    return holiday_names(date).isNotNull()


def is_major(names: Column) -> Column:
    out = F.lit(False)
    for n in MAJOR_NAMES:
        out = out | names.contains(n)
    return F.coalesce(out, F.lit(False))


def calendar_features(df: DataFrame, local: str = "local_ts") -> DataFrame:
    """Weekday (Monday 0), hour ending, weekend and holiday flags on the local clock."""
    dow = F.weekday(local)
    return df.withColumns({
        "day_of_week": dow, "end_of_hour": F.hour(local) + 1, "is_weekend": dow >= 5,
        "is_holiday": F.when(F.col(local).isNotNull(), is_holiday(F.to_date(local))),
    })


def cyclical_columns(hour_local: str | Column = "hour_local", dow: str | Column = "day_of_week",
                     utc: str = "utc_ts") -> list[Column]:
    return [
        *cyclic(hour_local, 24, "etf_hour"), *cyclic(dow, 7, "etf_dow"), *cyclic(F.dayofyear(utc), 365.25, "etf_doy"),
        *cyclic(F.month(utc), 12, "etf_month"), *cyclic(F.weekofyear(utc), 52, "etf_woy"),
    ]


def holiday_calendar(df: DataFrame, ts: str = "utc_ts", pad_years: int = 1) -> DataFrame:
    """One row per calendar day of the data's years with the distance to both neighbouring holidays.

    Size follows the calendar (366 rows a year), not the data. pad_years=0 gives the
    published behaviour, where rows after the last holiday of the data read 365.
    """
    years = df.agg(F.min(F.year(ts)).alias("lo"), F.max(F.year(ts)).alias("hi")).where("lo is not null")
    days = years.select(F.explode(F.sequence(
        F.make_date(F.col("lo") - pad_years, F.lit(1), F.lit(1)), F.make_date(F.col("hi") + pad_years, F.lit(12), F.lit(31))
    )).alias("day")).withColumn("names", holiday_names("day"))
    mark = F.when(F.col("names").isNotNull(), F.col("day"))
    w = Window.orderBy("day")
    nxt = F.min(mark).over(w.rowsBetween(1, Window.unboundedFollowing))
    last = F.max(mark).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return days.select(
        "day", F.col("names").isNotNull().alias("etf_is_federal_holiday"), is_major(F.col("names")).alias("etf_is_major_holiday"),
        F.coalesce(F.datediff(nxt, "day"), F.lit(365)).alias("etf_days_to_holiday"),
        F.coalesce(F.datediff("day", last), F.lit(365)).alias("etf_days_from_holiday"),
    )


def holiday_features(df: DataFrame, ts: str = "utc_ts", pad_years: int = 1, years_of: DataFrame | None = None) -> DataFrame:
    """Holiday distance and proximity columns on the UTC date.

    `years_of` is a table with the same dates from which the years can be read at less cost.
    """
    cal = holiday_calendar(df if years_of is None else years_of, ts, pad_years)
    j = join_measured(df.withColumn("day", F.to_date(ts)), cal, ["day"], "left").drop("day")
    to, frm = F.col("etf_days_to_holiday"), F.col("etf_days_from_holiday")
    return j.withColumns({
        "etf_is_pre_holiday": (to <= 1) & (to > 0), "etf_is_post_holiday": (frm <= 1) & (frm > 0),
        "etf_is_holiday_week": (to <= 3) | (frm <= 3),
    })
