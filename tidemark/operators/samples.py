"""Samples of what the read queries serve: JSON bodies with capped lists, and a leak scan over every string in them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import pii

CAP = 3


def cut(value, cap: int, marker: bool = True):
    """A JSON value in which no list, at any depth, is longer than cap; with a marker, what is left out is said in one string at its end."""
    if isinstance(value, dict):
        return {k: cut(v, cap, marker) for k, v in value.items()}
    if not isinstance(value, list):
        return value
    short = [cut(v, cap, marker) for v in value[:cap]]
    return [*short, f"... {len(value) - cap} more"] if marker and len(value) > cap else short


def _strings(value, path: str = "$"):
    if isinstance(value, str):
        yield path, value
    elif isinstance(value, dict):
        for k, v in value.items():
            yield from _strings(v, f"{path}.{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from _strings(v, f"{path}[{i}]")


def capped(body: Column, cap: int = CAP, marker: bool = True) -> Column:
    """A JSON text with its lists capped at every depth, without white space between values; null stays null."""

    @F.pandas_udf(T.StringType())
    def shorten(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: None if b is None else json.dumps(cut(json.loads(b), cap, marker), ensure_ascii=False, separators=(",", ":")))

    return shorten(body)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())])))
def strings(bodies: pd.Series) -> pd.Series:
    """Every string of a JSON text with its path; keys are not among them."""
    return bodies.map(lambda b: [] if b is None else [{"path": p, "value": v} for p, v in _strings(json.loads(b))])


def samples(views: dict[str, DataFrame], cap: int = CAP, marker: bool = True) -> DataFrame:
    """(name, body) of each view: a list of its first rows in its own order, their lists capped too, and how many more it has. A view's rows are counted; `cap` of them are sent."""
    out = None
    for name, view in views.items():
        row = F.to_json(F.struct(*view.columns), {"ignoreNullFields": "false"})
        first = view.limit(cap).coalesce(1).select(F.monotonically_increasing_id().alias("at"), capped(row, cap, marker).alias("row"))
        rows = first.agg(F.sort_array(F.collect_list(F.struct("at", "row")))["row"].alias("rows"))
        more = F.when(F.lit(marker) & (F.col("n") > cap), F.array(F.concat(F.lit('"... '), (F.col("n") - cap).cast("string"), F.lit(' more"'))))
        items = F.concat("rows", F.coalesce(more, F.array().cast("array<string>")))
        one = rows.crossJoin(view.agg(F.count(F.lit(1)).alias("n"))).select(F.lit(name).alias("name"), F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")).alias("body"))  # of one row each
        out = one if out is None else out.unionByName(one)
    return out


def leaks(bodies: DataFrame, body: str = "body") -> DataFrame:
    """The given columns but the body, with path and pattern: one row for each pattern that a string of a body hits; no value is shown."""
    keep = [c for c in bodies.columns if c != body]
    leaf = bodies.select(*keep, F.explode(strings(body)).alias("_s"))
    return leaf.select(*keep, F.col("_s.path").alias("path"), F.explode(pii.leak_hits(F.col("_s.value"))).alias("pattern"))
