"""Scalar expressions shared by the stages: white space, missing values, booleans, paths, ratios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a CSV reader of data frames takes for missing.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
# Texts that are true.
TRUE_WORDS = ["true", "1", "yes", "y", "t"]
#: The in-band mark for an unknown value.
UNKNOWN = "U"

# All Unicode white space and the separators.
_BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends (``trim`` by itself removes spaces alone)."""
    return F.trim(text, F.lit(_BLANKS))


def norm(text: Column) -> Column:
    """Stripped and lower-cased; null as ''."""
    return F.coalesce(F.lower(strip(text.cast("string"))), F.lit(""))


def na_normalize(df: DataFrame, *columns: str) -> DataFrame:
    """Missing-value tokens of string columns (all, or those named) as null: what a CSV round trip does."""
    names = columns or [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return df.withColumns({c: F.when(~F.col(f"`{c}`").isin(NA_TOKENS), F.col(f"`{c}`")) for c in names})


def parse_bool(value: Column) -> Column:
    """Booleans at scoring: null is false, else the text must be a true word, so 1.0 is false."""
    return F.coalesce(F.lower(strip(value.cast("string"))).isin(TRUE_WORDS), F.lit(False))


def parse_bool_value(value: Column, kind: str) -> Column:
    """Booleans of a checklist table by type: a number is true unless zero (a missing one too), a text by its word."""
    if kind == "boolean":
        return F.coalesce(value, F.lit(False))
    if kind == "string":
        return F.coalesce(F.lower(strip(value)).isin(TRUE_WORDS), F.lit(False))
    return F.coalesce(value != 0, F.lit(True))


def safe_div(a: Column, b: Column) -> Column:
    """a / b as doubles, 0.0 over zero."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def any_true(*flags: Column) -> Column:
    return reduce(lambda a, b: a | b, flags, F.lit(False))


def prompt_id_of(path: Column, trailing: bool = True) -> Column:
    """The prompt's number in a path: a folder, the last folder (with ``trailing``), the file's name, else unknown."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    tries = [F.regexp_extract(path, r"/prompt(\d+)/", 1)]
    if trailing:
        tries.append(F.regexp_extract(path, r"/prompt(\d+)$", 1))
    tries.append(F.regexp_extract(base, r"_prompt(\d+)", 1))
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in tries), F.lit(UNKNOWN))


def model_of(path: Column) -> Column:
    """The model's name in a results file's path, else unknown."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    plain = F.regexp_replace(F.regexp_replace(F.regexp_extract(base, r"results_(.+)", 1), r"_formated$", ""), r"_formatted$", "")
    return F.coalesce(F.nullif(F.regexp_extract(base, r"results_(.+?)_prompt\d+", 1), F.lit("")), F.nullif(plain, F.lit("")), F.lit(UNKNOWN))


def plain_path(uri: Column) -> Column:
    """The path that a file's URI in the metadata column spells with escapes."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def table_file(path: Column) -> Column:
    """A table's path: without the name of a part file, where the table is a folder named as a file."""
    return F.regexp_replace(path, r"(\.[cC][sS][vV])/[^/]*$", "$1")


def id_of_file(name: Column) -> Column:
    """A report's id: its file name without ``.json``, then ``.legacy``, then ``_report``, each once."""
    return reduce(lambda c, tail: F.regexp_replace(c, tail, ""), [r"\.json$", r"\.legacy$", r"_report$"], name)


def prefixed(columns: list[str], prefix: str, exclude: tuple[str, ...] = ()) -> list[str]:
    return [c for c in columns if c.startswith(prefix) and c not in exclude]


def require(df: DataFrame, *columns: str) -> DataFrame:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing required columns: {missing}")
    return df
