"""Half-open periods [from, until) as pairs of columns: relations, predicates and derivation of missing boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Open ends, as Spark dates and timestamps have no infinity. Fixed values; never calculate with them.
FOREVER_DATE, BEGINNING_DATE = "9999-12-31", "0001-01-01"
FOREVER_TIME, BEGINNING_TIME = "9999-12-31 23:59:59.999999", "0001-01-01 00:00:00"

#: The thirteen relations in the order in which they are tried.
ALLEN_RELATIONS = (
    "precedes", "meets", "overlaps", "starts", "during", "finishes", "equals",
    "preceded_by", "met_by", "overlapped_by", "started_by", "contains", "finished_by",
)

_DISCRETE = (T.DateType, T.IntegerType, T.LongType, T.ShortType)
_SUPPORTED = (*_DISCRETE, T.DecimalType, T.TimestampType, T.TimestampNTZType)


def boundary_type(df: DataFrame, column: str) -> T.DataType:
    """The type of a boundary column; raises for types that periods can't have."""
    found = df.schema[column].dataType
    if not isinstance(found, _SUPPORTED):
        raise TypeError(f"Unsupported range type: {found.simpleString()}")
    return found


def is_discrete(kind: T.DataType) -> bool:
    return isinstance(kind, _DISCRETE)


def forever(kind: T.DataType) -> Column | None:
    """The open end of a boundary type; None for numbers, which have none."""
    if isinstance(kind, T.DateType):
        return F.lit(FOREVER_DATE).cast(kind)
    return F.lit(FOREVER_TIME).cast(kind) if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else None


def beginning(kind: T.DataType) -> Column | None:
    if isinstance(kind, T.DateType):
        return F.lit(BEGINNING_DATE).cast(kind)
    return F.lit(BEGINNING_TIME).cast(kind) if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else None


def allen(xf: Column, xu: Column, yf: Column, yu: Column) -> Column:
    """Which of ALLEN_RELATIONS the period x has to y; null if a boundary is null."""
    tests = {
        "precedes": xu < yf, "meets": xu == yf, "overlaps": (xf < yf) & (yf < xu) & (xu < yu), "starts": (xf == yf) & (xu < yu),
        "during": (xf > yf) & (xu < yu), "finishes": (xf > yf) & (xu == yu), "equals": (xf == yf) & (xu == yu), "preceded_by": yu < xf,
        "met_by": yu == xf, "overlapped_by": (yf < xf) & (xf < yu) & (yu < xu), "started_by": (xf == yf) & (yu < xu),
        "contains": (xf < yf) & (yu < xu), "finished_by": (xf < yf) & (xu == yu),
    }
    out = F.when(xf.isNull() | xu.isNull() | yf.isNull() | yu.isNull(), F.lit(None).cast("string"))
    for name in ALLEN_RELATIONS:
        out = out.when(tests[name], name)
    return out


def overlaps(af: Column, au: Column, bf: Column, bu: Column) -> Column:
    return (af < bu) & (bf < au)


def contains_point(f: Column, u: Column, at: Column) -> Column:
    return (f <= at) & (at < u)


def contains_period(f: Column, u: Column, inner_f: Column, inner_u: Column) -> Column:
    return (f <= inner_f) & (inner_u <= u)


def intersection(af: Column, au: Column, bf: Column, bu: Column) -> tuple[Column, Column]:
    """Boundaries of the common part; it is empty where the first is not below the second."""
    return F.greatest(af, bf), F.least(au, bu)


def is_empty(f: Column, u: Column) -> Column:
    return f >= u


def successor(value: Column, kind: T.DataType) -> Column:
    """The next value of a discrete type; the open end stays as it is."""
    step = F.date_add(value, 1) if isinstance(kind, T.DateType) else (value + F.lit(1)).cast(kind)
    end = forever(kind)
    return step if end is None else F.when(value == end, end).otherwise(step)


def predecessor(value: Column, kind: T.DataType) -> Column:
    step = F.date_sub(value, 1) if isinstance(kind, T.DateType) else (value - F.lit(1)).cast(kind)
    end = forever(kind)
    return step if end is None else F.when(value == end, end).otherwise(step)


def canonical(f: Column, u: Column, bounds: Column, kind: T.DataType) -> tuple[Column, Column]:
    """Boundaries of a discrete period written with any of [) [] () (] as those of the half-open one."""
    if not is_discrete(kind):
        raise TypeError("only discrete periods have a canonical form")
    return F.when(F.startswith(bounds, F.lit("(")), successor(f, kind)).otherwise(f), F.when(F.endswith(bounds, F.lit("]")), successor(u, kind)).otherwise(u)


def normalize_period(
    df: DataFrame, valid_from: str = "valid_from", valid_until: str = "valid_until", valid_to: str | None = "valid_to", range_column: str | None = None,
    error: str = "period_error",
) -> DataFrame:
    """df with both boundaries filled in and, for a discrete period with valid_to, that column as well.

    Each boundary comes from what is there: the struct range_column (lower, upper), the boundary itself, or the day or
    number after the inclusive valid_to; an end that nothing gives is the open one. `error` says what is wrong with a row,
    null if nothing: sources that disagree, no start, or a start not below the end.
    """
    has_to, has_range = bool(valid_to) and valid_to in df.columns, bool(range_column) and range_column in df.columns
    kind = boundary_type(df, valid_from) if valid_from in df.columns else df.schema[range_column].dataType["lower"].dataType
    if has_to and not is_discrete(kind):
        raise TypeError("valid_to needs a discrete type")
    own = lambda c: F.col(c) if c in df.columns else F.lit(None).cast(kind)
    lower = F.col(range_column)["lower"] if has_range else F.lit(None).cast(kind)
    upper = F.col(range_column)["upper"] if has_range else F.lit(None).cast(kind)
    after = successor(F.col(valid_to), kind) if has_to else F.lit(None).cast(kind)
    end = forever(kind)
    f = F.coalesce(lower, own(valid_from))
    u = F.coalesce(upper, own(valid_until), after, *([] if end is None else [end]))
    apart = lambda a, b: a.isNotNull() & b.isNotNull() & (a != b)
    wrong = (
        F.when(apart(lower, own(valid_from)) | apart(upper, own(valid_until)), "range and boundary columns disagree")
        .when(apart(own(valid_until), after) | apart(upper, after), "valid_to and valid_until disagree")
        .when(f.isNull(), "the start is missing")
        .when(u.isNull(), "the end is missing")
        .when(f >= u, "the start is not before the end")
    )
    out = df.withColumn("_f", f).withColumn("_u", u).withColumn(error, wrong)
    out = out.withColumns({valid_from: F.col("_f"), valid_until: F.col("_u")})
    if has_to:
        out = out.withColumn(valid_to, predecessor(F.col("_u"), kind))
    return out.drop("_f", "_u")
