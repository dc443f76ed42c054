"""Small text rules shared by several jobs."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_first(text: Column, rules) -> Column:
    """Value of the first rule whose needle occurs in text; null when none does.

    The tables are short and fixed, so a CASE chain inside codegen replaces a theta join."""
    chain = None
    for needle, value in rules:
        hit = text.contains(needle)
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain


def equals_first(key: Column, pairs) -> Column:
    chain = None
    for spelling, value in pairs:
        hit = key == spelling
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain


def human_bytes(n: Column) -> Column:
    """1023 -> '1023 B', 1536 -> '1.5 KB', above 1 MiB in MB; one decimal."""
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.concat(one_decimal(n / F.lit(1024.0)), F.lit(" KB")))
        .otherwise(F.concat(one_decimal(n / F.lit(1024.0 * 1024.0)), F.lit(" MB")))
    )


def one_decimal(x: Column) -> Column:
    # ties go to the even digit: 1280 bytes are 1.2 KB
    return F.format_string("%.1f", F.bround(x, 1))


def shorten(text: Column, n: int) -> Column:
    """At most n characters, with '...' when something was cut."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def plural(n: Column) -> Column:
    return F.when(n == 1, F.lit("")).otherwise(F.lit("s"))


def lossy_text(payload: Column) -> Column:
    """Binary to text, replacing invalid sequences."""
    return F.make_valid_utf8(payload.cast("string"))
