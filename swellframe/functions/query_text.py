"""Values out of a raw URL query string."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from swellframe.functions.plain import with_plain_column

# The query parameters that the routes read.
QUERY_NAMES = (
    "lat",
    "lng",
    "latitude",
    "longitude",
    "params",
    "source",
    "start",
    "end",
    "datum",
    "units",
    "app_id",
    "key",
)


def with_query_values(rows: DataFrame, query: str = "query", name: str = "q") -> DataFrame:
    """``rows`` with the decoded parameters of a raw query in a struct column.

    A parameter that does not occur is null, one that is given without a value is '',
    and of one given more than once the first counts. Pairs with a bad escape or a
    semicolon are left out, as URL decoding does.

    The query is split and decoded once per row; each parameter is then a lookup by
    position.
    """
    # Decoding is left out for plain pairs; a null name never matches.
    decode = "if(contains(pair, '%') OR contains(pair, '+'), try_url_decode({0}), {0})".format
    pair_name = "substring_index(pair, '=', 1)"
    pairs = f"""
      transform(split({query}, '&'), pair -> named_struct(
        'name', if(contains(pair, ';'), NULL, {decode(pair_name)}),
        'value', {decode(f"substr(pair, length({pair_name}) + 2)")}))"""
    found = f"""
      get(transform(array({pairs}), pairs -> named_struct(
        'names', transform(pairs, pair -> if(pair.value IS NULL, NULL, pair.name)),
        'values', pairs.value)), 0)"""
    values = ", ".join(
        f"'{wanted}', get(_found.values, array_position(_found.names, '{wanted}') - 1)"
        for wanted in QUERY_NAMES
    )
    decoded = with_plain_column(rows, "_found", F.expr(found))
    return decoded.withColumn(name, F.expr(f"named_struct({values})")).drop("_found")


def given(value: Column) -> Column:
    """A parameter's value, '' where it does not occur."""
    return F.coalesce(value, F.lit(""))


def either_value(first: Column, second: Column) -> Column:
    """The first value, or the second where that is missing or empty, else null."""
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(second, F.lit("")))
