"""Array, struct and JSON functions."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pubmeta.functions.blank import is_blank


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside lambdas.

    An expression written inside a lambda is evaluated again for every element;
    as the only element of an array it is evaluated once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _simple_upper(c: str) -> str:
    return "\u1e9e" if c == "\xdf" else c.title() if len(c.title()) == 1 else c


#: Characters that F.upper writes as several ones, and what each is as a single one.
_WIDE = "".join(c for c in map(chr, range(0x80, sys.maxunicode + 1)) if len(c.upper()) > 1)
_SINGLE = "".join(map(_simple_upper, _WIDE))


def upper_by_character(c: Column) -> Column:
    """Upper case with one character for each: a sharp s stays one letter and does not equal two."""
    one_by_one = F.transform(
        F.split(c, ""),
        lambda x: F.when(F.length(F.upper(x)) > 1, F.translate(x, _WIDE, _SINGLE)).otherwise(F.upper(x)),
    )
    plain = (F.octet_length(c) == F.length(c)) | (F.length(F.upper(c)) == F.length(c))
    return F.when(plain, F.upper(c)).otherwise(F.array_join(one_by_one, ""))


def distinct_ignore_case(arr: Column) -> Column:
    """Order-preserving distinct, ignoring case; the first spelling stays."""

    def keyed(x: Column, i: Column) -> Column:
        return F.struct(upper_by_character(x).alias("key"), i.alias("at"), x.alias("value"))

    def first_of_runs(ordered: Column) -> Column:
        before = F.filter(ordered, lambda x, i: (i == 0) | (F.get(ordered, i - 1)["key"] != x["key"]))
        by_place = F.array_sort(F.transform(before, lambda x: F.struct(x["at"], x["value"])))
        return F.transform(by_place, lambda x: x["value"])

    # equal keys are neighbours once sorted, the earliest first
    known = F.filter(arr, lambda x: x.isNotNull())
    return bind(F.array_sort(F.transform(known, keyed)), first_of_runs)


def first_non_blank(arr: Column) -> Column:
    return F.get(F.filter(arr, lambda x: ~is_blank(x)), F.lit(0))


def first_year(date_parts: Column) -> Column:
    """``[0][0]`` when it is a positive number."""
    year = F.get(F.get(date_parts, F.lit(0)), F.lit(0))
    return F.when(year > 0, year)


def join_non_blank(arr: Column, sep: str) -> Column:
    return F.array_join(F.filter(arr, lambda x: ~is_blank(x)), sep)


def parse_json_or_empty(c: Column, element: T.DataType) -> Column:
    """JSON list as an array; blank, invalid or non-list JSON gives an empty array.

    So does text after the list, and an element of another kind in a list of strings. Struct fields are read by
    their camelCase names.
    """
    schema = T.ArrayType(element)
    # as the only element of a list, text after the value is an error or a second element
    wrapped = F.concat(F.lit("["), c, F.lit("]"))
    fits = c.rlike(r"^\s*\[")
    if isinstance(element, T.StringType):
        kind = F.schema_of_variant(F.try_parse_json(wrapped))
        fits = fits & kind.isin("ARRAY<ARRAY<STRING>>", "ARRAY<ARRAY<VOID>>")
    read = F.from_json(F.when(fits, wrapped), camel_type(T.ArrayType(schema)))
    parsed = F.when(F.size(read) == 1, F.get(read, F.lit(0))).cast(schema)
    return F.coalesce(parsed, F.array().cast(schema))


def camel_case(name: str) -> str:
    head, *tail = name.split("_")
    return head + "".join(part.title() for part in tail)


def camel_type(dtype: T.DataType) -> T.DataType:
    """The same type with every struct field renamed to camelCase."""
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(camel_type(dtype.elementType), dtype.containsNull)
    if isinstance(dtype, T.StructType):
        return T.StructType(
            [T.StructField(camel_case(f.name), camel_type(f.dataType), f.nullable) for f in dtype.fields]
        )
    return dtype


def to_json_web(c: Column, dtype: T.DataType, keep_nulls: bool = True) -> Column:
    """camelCase JSON; NULL fields are written unless ``keep_nulls`` is off."""
    return F.to_json(c.cast(camel_type(dtype)), {"ignoreNullFields": str(not keep_nulls).lower()})


def split_scopes(c: Column) -> Column:
    """Space-separated scopes with the ``SCOPE_`` prefix; blank gives an empty array."""
    parts = F.filter(F.split(c, " "), lambda s: s != "")
    scopes = F.transform(parts, lambda s: F.concat(F.lit("SCOPE_"), s))
    return F.when(~is_blank(c), scopes).otherwise(F.array().cast("array<string>"))


def prefix_groups(arr: Column) -> Column:
    """Group names as role claims: ``ROLE_`` is added unless already there."""
    prefixed = F.transform(
        F.filter(arr, lambda g: ~is_blank(g)),
        lambda g: F.when(g.startswith("ROLE_"), g).otherwise(F.concat(F.lit("ROLE_"), g)),
    )
    return F.coalesce(prefixed, F.array().cast("array<string>"))


def position_pick(arr: Column, i: Column) -> Column:
    """The ``i``-th element, NULL when out of range."""
    return F.get(arr, i)
