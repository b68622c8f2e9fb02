"""Column expressions that the engines share. Rounding is half to even, as money reports expect here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY_LIKE = ("nan", "none", "-", "—")


def even(x: Column, digits: int = 0) -> Column:
    """Rounds half to even: the scaled value to the nearest whole number, scaled back."""
    if digits == 0:
        return F.rint(x)
    scale = float(10 ** abs(digits))
    return F.rint(x * scale) / scale if digits > 0 else F.rint(x / scale) * scale


def number(column: str | Column, default: float = 0.0) -> Column:
    """A double; what is missing, NaN or no number becomes default."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.nanvl(c.try_cast("double"), F.lit(None).cast("double")), F.lit(default))


def cleaned(column: str | Column) -> Column:
    """Trimmed text; what only looks like a value becomes empty."""
    c = F.trim(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")))
    return F.when(F.lower(c).isin(*EMPTY_LIKE), "").otherwise(c)


def growth(now: Column, before: Column) -> Column:
    """Change in per cent; 0 where there was nothing before."""
    return F.when(before > 0, (now - before) / before * 100).otherwise(F.lit(0.0))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def exact_sum(x: Column, scale: int = 4) -> Column:
    """A sum that doesn't depend on the order of rows: in decimals of scale digits."""
    return F.sum(x.cast(f"decimal(28,{scale})")).cast("double")


def exact_mean(x: Column, scale: int = 4) -> Column:
    return exact_sum(x, scale) / F.count(x)


def whole(x: Column) -> Column:
    """A number without digits after the point, half to even: 1234.5 as 1234."""
    return F.format_string("%.0f", F.rint(x))


def signed(x: Column) -> Column:
    """A whole number with its sign: +3, -12, +0."""
    return F.format_string("%+.0f", F.rint(x))


def grouped(x: Column, mark: str = ",") -> Column:
    """A whole number with a mark between thousands."""
    out = F.format_number(F.rint(x), 0)
    return out if mark == "," else F.translate(out, ",", mark)


def euros(x: Column) -> Column:
    """A whole amount as reports write it: 1.234 €."""
    return F.concat(grouped(x, "."), F.lit(" €"))


WEEKDAYS = ("Mo", "Di", "Mi", "Do", "Fr", "Sa", "So")


def day_text(date: Column, form: str = "long") -> Column:
    """A day as reports write it: long 24.12.2024, iso 2024-12-24, short 24.12., week Di 24.12."""
    if form == "week":
        return F.concat(F.get(F.array(*map(F.lit, WEEKDAYS)), F.weekday(date)), F.lit(" "), F.date_format(date, "dd.MM."))
    return F.date_format(date, {"long": "dd.MM.yyyy", "iso": "yyyy-MM-dd", "short": "dd.MM."}[form])


def first_word(text: Column) -> Column:
    """What stands before the first white space of a trimmed text."""
    return F.split(F.trim(text), r"\s+")[0]


def tier(x: Column, *steps: tuple[float, str], other: str) -> Column:
    """The name of the first threshold that x reaches."""
    out = F.when(x >= steps[0][0], steps[0][1])
    for least, name in steps[1:]:
        out = out.when(x >= least, name)
    return out.otherwise(other)


#: What the name of a measure says it counts, first hit wins.
UNITS = (
    ("Liter", ("liter", "beer", "bier", "ml", "cl")),
    ("Kilowattstunden", ("kwh", "energie", "energy", "strom", "power")),
    ("Euro", ("eur", "revenue", "umsatz", "sales", "price")),
    ("Bestellungen", ("order", "bestell")),
)


def unit_of(name: Column) -> Column:
    """The unit that a measure's name hints at."""
    out = F.lit("Einheiten")
    for unit, words in reversed(UNITS):
        out = F.when(F.lower(name).rlike("|".join(words)), unit).otherwise(out)
    return out


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(name, r"(?U)[^\w.\-]", "_")


#: Legal forms cut out of company names, in this order, wherever they stand.
LEGAL_FORMS = (
    "gmbh & co. kg", "gmbh & co kg", "gmbh co kg", "ag & co. kg", "ag & co kg",
    "gmbh", "ag", "kg", "ohg", "gbr", "se", "und söhne", "& söhne", "& co.", "& co",
)


def company_name(name: Column, forms: tuple[str, ...] = LEGAL_FORMS) -> Column:
    """A company name for comparison: lower case, without legal forms and umlauts, single spaces."""
    out = F.lower(F.coalesce(name, F.lit("")))
    for form in forms:
        out = F.replace(out, F.lit(form), F.lit(""))
    for a, b in (("ü", "ue"), ("ö", "oe"), ("ä", "ae"), ("ß", "ss"), ("-", " ")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(F.trim(out), r"\s+", " ")
