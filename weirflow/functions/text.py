"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def camel_to_snake(s: Column) -> Column:
    """Lower case with underscores where a word begins: a capital after a small letter or digit, or the last
    of a run of capitals that small letters follow."""
    return F.lower(F.regexp_replace(s, "(?<=[a-z0-9])(?=[A-Z])|(?<=.)(?=[A-Z][a-z])", "_"))


def snake_to_camel(s: Column) -> Column:
    """Words after blanks or underscores begin with a capital, the first in lower case, all joined."""
    parts = F.split(F.lower(s), "[ _]")
    titled = F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "")
    return F.concat(F.lower(F.substring(titled, 1, 1)), F.substring(titled, 2, 1 << 30))


def shorten_by_words(s: Column, n: int = 50) -> Column:
    """Leading words (parted by white space), each with a blank before it, while the whole has at most n characters."""
    start = F.struct(F.lit("").alias("t"), F.lit(True).alias("on"))

    def step(acc: Column, w: Column) -> Column:
        longer = F.concat(acc["t"], F.lit(" "), w)
        fits = acc["on"] & (F.length(longer) <= n)
        return F.struct(F.when(fits, longer).otherwise(acc["t"]).alias("t"), fits.alias("on"))

    return F.aggregate(F.filter(F.split(s, r"\s+"), lambda w: w != ""), start, step, lambda acc: acc["t"])


def word_wrap(s: Column, width: int = 80) -> Column:
    """Greedy lines of whole words up to `width`; a longer word has a line of its own."""
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("line"))

    def step(acc: Column, w: Column) -> Column:
        fits = (acc["line"] != "") & (F.length(acc["line"]) + 1 + F.length(w) <= width)
        first = acc["line"] == ""
        done = F.when(fits | first, acc["done"]).otherwise(F.concat(acc["done"], acc["line"], F.lit("\n")))
        line = F.when(fits, F.concat(acc["line"], F.lit(" "), w)).otherwise(w)
        return F.struct(done.alias("done"), line.alias("line"))

    return F.aggregate(F.filter(F.split(s, r"\s+"), lambda w: w != ""), start, step, lambda acc: F.concat(acc["done"], acc["line"]))


def short_scientific(x: Column, digits: int = 0) -> Column:
    """Mantissa and bare exponent, such as 3e-5."""
    text = F.format_string(f"%.{digits}e", x)
    return F.regexp_replace(F.regexp_replace(text, "e\\+0*", "e"), "e-0*", "e-")


def percent(n: Column, total: Column) -> Column:
    return F.concat(F.format_string("%.2g", n * 100.0 / total), F.lit("%"))


def is_integer(s: Column) -> Column:
    """Digits with an optional sign, and an optional point after which only zeros stand."""
    return s.rlike(r"^\s*[+-]?[0-9]+(\.0*)?\s*$")


def mixed_radix(values: list[Column], sizes: list[int]) -> Column:
    """One number for several categories."""
    out = F.lit(0).cast("long")
    for v, n in zip(values, sizes, strict=True):
        out = out * n + v
    return out
