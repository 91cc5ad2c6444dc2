"""Preprocessing that is fitted on the training rows and applied anywhere.

Numeric columns: missing values become the exact median, then (x - mean) / population
deviation, a deviation of zero counting as one. Other columns: missing values become the
most frequent value, of equally frequent ones the smallest, then one slot per value seen
in training; an unseen value has none. The fitted result is a persistable PipelineModel.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from credence.functions import parses_as_number
from credence.functions.parsing import _number
from credence.operators import selection
from credence.operators.categories import CategoryEncoder, build_dictionary


@dataclass(frozen=True)
class Routing:
    numeric: list[str]
    categorical: list[str]


def route_columns(rows: DataFrame, *, exclude: tuple[str, ...] = (), numeric: list[str] | None = None,
                  categorical: list[str] | None = None) -> Routing:
    """Which columns are numeric: number and boolean types, and strings whose every value is a number.

    One aggregation inspects all string columns. A column without any value is left out.
    Explicit lists override the inspection for the columns they name.
    """
    forced = {**{c: True for c in numeric or []}, **{c: False for c in categorical or []}}
    columns = [f for f in rows.schema.fields if f.name not in exclude]
    counts = {}
    if columns:
        checks = []
        for k, f in enumerate(columns):
            checks += [F.count(_value(f)).alias(f"n{k}"), F.count_if(parses_as_number(F.col(f"`{f.name}`"))).alias(f"p{k}")]
        counts = rows.agg(*checks).first().asDict()
    out: tuple[list[str], list[str]] = ([], [])
    for k, f in enumerate(columns):
        if not counts[f"n{k}"]:
            continue
        typed = isinstance(f.dataType, (T.NumericType, T.BooleanType))
        is_numeric = forced.get(f.name, typed or isinstance(f.dataType, T.StringType) and counts[f"p{k}"] == counts[f"n{k}"])
        out[0 if is_numeric else 1].append(f.name)
    if not out[0] and not out[1]:
        raise ValueError("No feature column has a value.")
    return Routing(*out)


def _value(field: T.StructField):
    """A column's value, NaN counting as missing."""
    column = F.col(f"`{field.name}`")
    return F.when(~F.isnan(column), column) if isinstance(field.dataType, (T.DoubleType, T.FloatType)) else column


def _as_double(rows: DataFrame, name: str):
    kind = rows.schema[name].dataType
    if isinstance(kind, T.StringType):
        return _number(F.trim(F.col(f"`{name}`")))
    if isinstance(kind, T.BooleanType):
        return F.col(f"`{name}`").cast("int").cast("double")
    return _value(rows.schema[name]).cast("double")


def _long(rows: DataFrame, values: list, kind: str) -> DataFrame:
    """(k, value, n): how often each distinct value of each column occurs, missing ones left out."""
    every = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), v.cast(kind).alias("value")) for k, v in enumerate(values)])).alias("s")
    return rows.select(every).select("s.*").filter("value IS NOT NULL").groupBy("k", "value").agg(F.count(F.lit(1)).alias("n"))


def _modes(rows: DataFrame, values: list) -> dict[int, str]:
    """The most frequent value of each column, by its place; of equally frequent ones the smallest."""
    best = _long(rows, values, "string").groupBy("k").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("value"))
    return {r["k"]: r["value"] for r in best.collect()}


def medians_and_modes(rows: DataFrame, routing: Routing) -> dict[str, float | str]:
    """The value that a missing one becomes, by column: medians by narrowing brackets, modes from
    counts per distinct value. No task holds the values of a column."""
    medians = selection.medians(rows, [_as_double(rows, c) for c in routing.numeric])
    modes = _modes(rows, [F.col(f"`{c}`") for c in routing.categorical]) if routing.categorical else {}
    return {c: medians.get(k) for k, c in enumerate(routing.numeric)} | {c: modes.get(k) for k, c in enumerate(routing.categorical)}


def scales(rows: DataFrame, routing: Routing, fill: dict) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each imputed numeric column."""
    if not routing.numeric:
        return {}
    asked = []
    for k, c in enumerate(routing.numeric):
        value = F.coalesce(_as_double(rows, c), F.lit(fill[c]))
        asked += [F.avg(value).alias(f"m{k}"), F.stddev_pop(value).alias(f"s{k}")]
    found = rows.agg(*asked).first()
    return {c: (found[f"m{k}"], found[f"s{k}"] or 1.0) for k, c in enumerate(routing.numeric)}


def impute(rows: DataFrame, routing: Routing, fill: dict) -> DataFrame:
    """Missing values replaced, numeric columns as doubles."""
    return rows.withColumns({c: F.coalesce(_as_double(rows, c), F.lit(fill[c])) for c in routing.numeric}
                            | {c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(fill[c])) for c in routing.categorical})


def standardize(rows: DataFrame, routing: Routing, fill: dict, scale: dict) -> DataFrame:
    done = impute(rows, routing, fill)
    return done.withColumns({c: (F.col(f"`{c}`") - F.lit(scale[c][0])) / F.lit(scale[c][1]) for c in routing.numeric})


_TYPED = {T.StringType: r"CASE WHEN trim({c}) RLIKE '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$' THEN try_cast(trim({c}) AS double) "
                        r"WHEN lower(trim({c})) RLIKE '^[+-]?inf(inity)?$' THEN IF(startswith(trim({c}), '-'), -double('Infinity'), double('Infinity')) END",
          T.BooleanType: "cast(cast({c} AS int) AS double)"}


def _literal(value) -> str:
    return "double('" + repr(float(value)) + "')" if isinstance(value, float) else "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def typed_columns(rows: DataFrame, routing: Routing, keep: tuple[str, ...] = ()) -> DataFrame:
    """`keep` and the routed columns as numbers and strings, parsed once for all passes over them."""
    return rows.select(*keep, *[_as_double(rows, c).alias(c) for c in routing.numeric], *[F.col(f"`{c}`").cast("string").alias(c) for c in routing.categorical])


def _dealt(schema: T.StructType, routing: Routing, fill: dict, scale: dict) -> SQLTransformer:
    """Imputed and scaled numeric columns as _n0, _n1, ..., imputed other ones as _c0, _c1, ..."""
    parts = []
    for k, c in enumerate(routing.numeric):
        typed = _TYPED.get(type(schema[c].dataType), "nullif(cast({c} AS double), double('NaN'))").replace("{c}", f"`{c}`")
        parts.append(f"(coalesce({typed}, {_literal(float(fill[c]))}) - {_literal(float(scale[c][0]))}) / {_literal(float(scale[c][1]))} AS _n{k}")
    for k, c in enumerate(routing.categorical):
        parts.append(f"coalesce(cast(`{c}` AS string), {_literal(str(fill[c]))}) AS _c{k}")
    return SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")


def fit_typed(schema: T.StructType, typed: DataFrame, routing: Routing, output: str = "features") -> tuple[PipelineModel, PipelineModel]:
    """The preprocessing of rows of a schema, and that of `typed`, their `typed_columns`: a few passes over these."""
    fill = medians_and_modes(typed, routing)
    scale = scales(typed, routing, fill)
    held = build_dictionary(typed, [F.col(f"`{c}`") for c in routing.categorical], routing.categorical) if routing.categorical else None
    encoder = CategoryEncoder(numericCols=[f"_n{k}" for k in range(len(routing.numeric))], categoryCols=[f"_c{k}" for k in range(len(routing.categorical))], outputCol=output,
                              **({"sizes": held.sizes, "bytes": held.bytes, "dictionary": held.path} if held else {}))
    return PipelineModel([_dealt(schema, routing, fill, scale), encoder]), PipelineModel([_dealt(typed.schema, routing, fill, scale), encoder])


def fit_preprocessor(rows: DataFrame, *, exclude: tuple[str, ...] = (), output: str = "features",
                     numeric: list[str] | None = None, categorical: list[str] | None = None) -> PipelineModel:
    """A few passes over the training rows: routes, medians and modes, scales, the dictionary of categories."""
    routing = route_columns(rows, exclude=exclude, numeric=numeric, categorical=categorical)
    typed = typed_columns(rows, routing).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return fit_typed(rows.schema, typed, routing, output)[0]
    finally:
        typed.unpersist()


def one_hot_long(rows: DataFrame, train: DataFrame, columns: list[str], id_column: str) -> DataFrame:
    """The one-hot block as (id, column, category) rows: one row for each slot that is 1."""
    routing = Routing([], columns)
    fill = medians_and_modes(train, routing)
    seen = impute(train, routing, fill).select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("category")) for c in columns])).alias("s")).select("s.*").distinct()
    own = impute(rows, routing, fill).select(id_column, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("category")) for c in columns])).alias("s")).select(id_column, "s.*")
    return own.join(seen, ["column", "category"], "left_semi").select(id_column, "column", "category")
