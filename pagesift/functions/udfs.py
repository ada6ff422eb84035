"""The engine's two Arrow UDFs (one page per row, narrow)."""

from __future__ import annotations

import functools
import html as _html

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesift.config import MAX_STEPS
from pagesift.functions.fold import fold_tokens

SLICE = 16  # pages held as Python objects at once

FOLD_SCHEMA = T.StructType([
    T.StructField("kind", T.ArrayType(T.StringType())),
    T.StructField("name", T.ArrayType(T.StringType())),
    T.StructField("raw", T.ArrayType(T.StringType())),
    T.StructField("synthetic", T.ArrayType(T.BooleanType())),
    T.StructField("tag", T.ArrayType(T.StringType())),
    T.StructField("cls", T.ArrayType(T.StringType())),
    T.StructField("anc", T.ArrayType(T.ArrayType(T.IntegerType()))),
    T.StructField("run", T.ArrayType(T.StringType())),
    T.StructField("parent", T.ArrayType(T.IntegerType())),
    T.StructField("depth", T.ArrayType(T.IntegerType())),
])


def by_slices(compute, out: pa.DataType, *columns: pa.Array) -> pa.Array:
    """``compute(*lists)`` of ``SLICE`` rows after the other, each result turned into Arrow (type ``out``) before
    the next rows become Python objects: a worker's memory does not follow the size of its batches."""
    parts = [pa.array(compute(*[c.slice(at, SLICE).to_pylist() for c in columns]), out) for at in range(0, len(columns[0]), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], out)


def _unescape(s: pa.Array) -> pa.Array:
    """Decode named and numeric character references (HTML5 rules)."""
    return by_slices(lambda rows: [_html.unescape(x) if x is not None and "&" in x else x for x in rows], pa.string(), s)


# Both UDFs are pure, but are declared non-deterministic so that Catalyst
# evaluates each exactly once per row: otherwise a filter on a column
# derived from them is pushed below the projection (and the scan-side
# repartition) and the UDF runs a second time there.
html_unescape = F.arrow_udf(_unescape, T.StringType()).asNondeterministic()


def _folder(max_anc):
    def _fold(tokens: pa.Array) -> pa.Array:
        """Token array -> struct of parallel event arrays (see ``fold.fold_tokens``)."""
        text, number = pa.list_(pa.string()), pa.list_(pa.int32())
        types = (text, text, text, pa.list_(pa.bool_()), text, text, pa.list_(number), text, number, number)
        names = ("kind", "name", "raw", "synthetic", "tag", "cls", "anc", "run", "parent", "depth")
        parts = []
        for at in range(0, len(tokens), SLICE):
            folded = [fold_tokens(toks, max_anc) for toks in tokens.slice(at, SLICE).to_pylist()]
            parts.append(pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*folded), types)], names=names))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct(list(zip(names, types))))
    return _fold


@functools.lru_cache(maxsize=None)
def fold_udf(max_anc: int | None):
    """The fold as a UDF: full ancestor lists (``max_anc=None``, for paths printed
    whole) or only the root-most ``max_anc`` of them, which bounds a
    pathologically deep page to O(events) integers."""
    return F.arrow_udf(_folder(max_anc), FOLD_SCHEMA).asNondeterministic()


fold_events = fold_udf(None)
fold_events_compact = fold_udf(MAX_STEPS)
