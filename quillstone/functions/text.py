"""Column expressions over text that people typed: spacing, blanks in disguise, numbers, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Row order of a loaded table; the only order there is.
ROW_ID = "__row_id"

# What counts as a blank in disguise, the marks of human numbers, and the
# signs of text that was decoded twice.
TOKENS = (
    "?", "??", "n/a", "n\\a", "na", "null", "none", "nil", "nan", "-", "--", "---", ".",
    "unknown", "unspecified", "missing", "", "-999", "-9999", "999", "9999",
)
SPACING_MARKS = (" ", " ", "'", "_")
UNIT_MARKS = ("$", "€", "£", "лв", "lv", "BGN", "EUR", "USD", "%")
MOJIBAKE = ("Ð", "Ñ", "Ã", "â€", "Â", "ï»¿")
DATE_LAYOUTS = (
    ("yyyy-M-d", "YYYY-MM-DD"), ("d/M/yyyy", "DD/MM/YYYY"), ("M/d/yyyy", "MM/DD/YYYY"),
    ("d.M.yyyy", "DD.MM.YYYY"), ("d-M-yyyy", "DD-MM-YYYY"), ("yyyy/M/d", "YYYY/MM/DD"),
)

NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
INFINITE = r"(?i)^[+-]?inf(?:inity)?$"
_DAY = r"\d{1,4}([-/.])\d{1,2}\1\d{1,4}"
DATE_SHAPED = rf"^\s*(?:\d{{8}}|{_DAY}(?:[ T].*)?)\s*$"


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends (trim knows only U+0020)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tidy(c: Column) -> Column:
    """Stripped, every run of white space a single blank."""
    return F.regexp_replace(strip(c), r"(?U)\s+", " ")


def fold(c: Column) -> Column:
    """Lower case for comparing; the one common letter that lower() leaves is folded too."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def normalise(c: Column) -> Column:
    return fold(tidy(c))


def is_token(c: Column) -> Column:
    """A blank in disguise (null stays null)."""
    return F.lower(strip(c)).isin(*TOKENS)


def real(c: Column) -> Column:
    """The stripped value, null where it is a blank in disguise."""
    return F.when(~is_token(c), strip(c))


def number(c: Column) -> Column:
    """The number a text says, else null; stricter than a cast, which takes 5d and NaN."""
    bare = strip(c)
    infinite = F.when(bare.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(bare.rlike(NUMBER), bare.try_cast("double")).when(bare.rlike(INFINITE), infinite)


def date(c: Column) -> Column:
    """The moment a text says, by a fixed list of layouts; a/b/y is month first where it can be."""
    bare = strip(c)
    layouts = ("yyyy-M-d", "yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s", "yyyy/M/d", "M/d/yyyy", "d/M/yyyy", "M-d-yyyy", "d-M-yyyy", "d.M.yyyy", "yyyyMMdd")
    return F.when(bare.rlike(DATE_SHAPED), F.coalesce(*[F.try_to_timestamp(bare, F.lit(x)) for x in layouts]))


def layout(c: Column) -> Column:
    """Label of the first layout that reads the value."""
    out = F.lit(None).cast("string")
    for pattern, label in reversed(DATE_LAYOUTS):
        out = F.when(F.try_to_timestamp(strip(c), F.lit(pattern)).isNotNull(), F.lit(label)).otherwise(out)
    return out


def _units() -> str:
    return "(?i)" + "|".join("\\" + m if m == "$" else m for m in UNIT_MARKS)


def unmarked(c: Column) -> Column:
    """Without the marks of human numbers; commas are left for unmarked_number."""
    spaced = F.regexp_replace(c, "[" + "".join(SPACING_MARKS) + "]", "")
    return strip(F.regexp_replace(spaced, _units(), ""))


def comma_decimal(c: Column) -> Column:
    """The value ends in a decimal comma; one such value makes all commas of its column decimal."""
    return unmarked(c).rlike(r"^-?\d+,\d{1,3}$")


def unmarked_number(c: Column, commas: bool) -> Column:
    bare = unmarked(c)
    return number(F.replace(bare, F.lit(","), F.lit(".")) if commas else bare)


def marks_in(c: Column) -> dict[str, Column]:
    """For each mark: whether the value holds it."""
    found = {m: F.contains(c, F.lit(m)) for m in SPACING_MARKS}
    return found | {m: F.contains(F.lower(c), F.lit(m.lower())) for m in UNIT_MARKS}


def starts_like(c: Column, regex: str) -> Column:
    """Matches at the start; rlike alone would search."""
    return c.rlike(f"^(?:{regex})")


def quoted(name: str) -> Column:
    """A column by its exact name, whatever marks it holds."""
    return F.col("`" + name.replace("`", "``") + "`")
