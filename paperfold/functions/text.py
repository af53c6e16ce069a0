"""Scalar text functions as Column expressions (whitespace, budgets, names)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters str.strip() removes, and the matching regex class.
# Spark's trim() removes only U+0020 and its \s is ASCII, so both are spelled out.
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WS = r"[\s\x1c-\x1f]"
U = "(?U)"
TRUNCATION_MARKER = "[...truncated for context budget]"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use`` (a one-element transform).

    A lambda that mentions an outer expression re-evaluates it per element; binding
    it first keeps array work linear.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def bind(use, *names: str) -> Column:
    """``let`` over columns: a struct of them, evaluated once per row.

    The optimizer may merge projections and so inline a computed column into a lambda
    body; bound this way it still runs once.
    """
    return let(F.struct(*[F.col(n).alias(n) for n in names]), use)


def strip(c: Column | str) -> Column:
    """Both-side trim over the full Unicode whitespace set."""
    return F.btrim(as_col(c), F.lit(WS_CHARS))


def rstrip(c: Column | str) -> Column:
    return F.rtrim(as_col(c), F.lit(WS_CHARS))


def nonempty(c: Column | str) -> Column:
    """The string, or NULL when it is empty."""
    return F.nullif(as_col(c), F.lit(""))


def compact(c: Column | str) -> Column:
    """Runs of whitespace become one space; ends trimmed."""
    return F.regexp_replace(strip(c), f"{U}{WS}+", " ")


def words(c: Column | str) -> Column:
    return F.filter(F.split(compact(c), " "), lambda w: w != "")


def truncate_text(c: Column | str, max_chars: int) -> Column:
    flat = compact(c)
    if max_chars <= 3:
        cut = F.lit("." * max(max_chars, 0))
    else:
        cut = F.concat(rstrip(F.substring(flat, 1, max_chars - 3)), F.lit("..."))
    return F.when(F.length(flat) <= max_chars, flat).otherwise(cut)


def strip_nul(c: Column | str, dtype: T.DataType | None = None) -> Column:
    """Remove NUL characters at every depth of a string/array/struct/map value."""
    col = as_col(c)
    dtype = dtype or T.StringType()
    if isinstance(dtype, T.StringType):
        return F.replace(col, F.lit("\u0000"), F.lit(""))
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: strip_nul(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(col, lambda _, v: strip_nul(v, dtype.valueType))
    if isinstance(dtype, T.StructType):
        rebuilt = F.struct(
            *[strip_nul(col[f.name], f.dataType).alias(f.name) for f in dtype.fields]
        )
        return F.when(col.isNotNull(), rebuilt)
    return col


def token_estimate(c: Column | str) -> Column:
    """max(1, len // 4): the default, pluggable token estimator."""
    return F.greatest(F.lit(1), F.floor(F.length(as_col(c)) / 4).cast("int"))


def truncate_to_tokens(c: Column | str, max_tokens: Column | int) -> Column:
    """Longest whole-word prefix whose estimate fits, plus the truncation marker.

    With the default estimator "estimate <= t" means "length <= 4t + 3", so the
    prefix is one substring cut at the last blank: linear, no word-by-word fold.
    """
    text = as_col(c)
    marker = max(1, len(TRUNCATION_MARKER) // 4)
    cap = max_tokens if isinstance(max_tokens, Column) else F.lit(max_tokens)
    target = F.greatest(F.lit(1), cap - marker)
    flat = compact(text)
    room = target * 4 + 3
    window = F.substring(flat, F.lit(1), room + 1)
    whole_words = F.regexp_replace(window, r" [^ ]*\z", "")
    body = (
        F.when((flat != "") & (F.length(flat) <= room), flat)
        .when(window.contains(" "), whole_words)
        .otherwise(rstrip(F.substring(text, F.lit(1), target * 4)))
    )
    return F.concat(body, F.lit(" " + TRUNCATION_MARKER))


def truncate_to_tokens_with(c: Column | str, max_tokens: Column | int, estimator) -> Column:
    """The same cut for any estimator (a Column function): a fold over words."""
    text = as_col(c)
    cap = max_tokens if isinstance(max_tokens, Column) else F.lit(max_tokens)
    target = F.greatest(F.lit(1), cap - estimator(F.lit(TRUNCATION_MARKER)))
    start = F.struct(F.lit("").alias("t"), F.lit(False).alias("done"))

    def step(acc: Column, word: Column) -> Column:
        nxt = F.when(acc["t"] == "", word).otherwise(F.concat(acc["t"], F.lit(" "), word))
        stop = acc["done"] | (estimator(nxt) > target)
        return F.struct(
            F.when(stop, acc["t"]).otherwise(nxt).alias("t"), stop.alias("done")
        )

    kept = F.aggregate(words(text), start, step, lambda acc: acc["t"])
    body = F.when(kept != "", kept).otherwise(
        rstrip(F.substring(text, F.lit(1), (target * 4).cast("int")))
    )
    return F.concat(body, F.lit(" " + TRUNCATION_MARKER))


def excerpt(c: Column | str, chars: int = 500) -> Column:
    return F.substring(as_col(c), 1, chars)


def clean_key(c: Column | str) -> Column:
    """Header name reduced to lowercase alphanumerics."""
    return F.lower(F.regexp_replace(as_col(c), r"(?U)[^\p{Alnum}]", ""))


def normalize_email(c: Column | str) -> Column:
    return nonempty(F.lower(strip(c)))


def email_domain(c: Column | str) -> Column:
    """Part after the first '@'; NULL unless both parts are non-empty."""
    parts = F.split(normalize_email(c), "@", 2)
    return F.when(
        (F.get(parts, F.lit(0)) != "") & (F.get(parts, F.lit(1)) != ""),
        F.get(parts, F.lit(1)),
    )


def display_name(c: Column | str) -> Column:
    """Slug to title: split on - and _, keep ALLCAPS words, capitalise the rest."""
    name = as_col(c)
    parts = words(F.translate(name, "-_", "  "))
    titled = F.transform(
        parts,
        lambda p: F.when((F.upper(p) == p) & (F.lower(p) != p), p).otherwise(
            F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2))))
        ),
    )
    return F.when(F.size(parts) == 0, name).otherwise(F.array_join(titled, " "))


def round4(c: Column | str) -> Column:
    return F.round(as_col(c), 4)


def is_finite(c: Column | str) -> Column:
    value = as_col(c)
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
