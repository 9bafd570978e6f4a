"""Kernels over ordered series: one call per series, out of sorted partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.operators.series import whole_series


def per_series(
    df: DataFrame, by: list[str], order: list[str], values: list[str], kernel: Callable[..., dict[str, object]], schema: str
) -> DataFrame:
    """``kernel`` on each series: it gets a float array per column of ``order`` and ``values`` and gives columns by name.

    ``schema`` describes what the kernel gives; the columns of ``by`` come first. Scalars give one
    row. Rows are exchanged once by ``by`` and sorted; a task holds one series at a time. Put a
    block of time into ``by`` wherever the kernel may start anew there: it is what splits a source
    that holds most rows. Null keys are dropped; null values reach the kernel as NaN.
    """
    keyed = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in by)).select(*by, *[F.col(c).cast("double").alias(c) for c in dict.fromkeys([*order, *values])])
    kinds = {f.name: f.dataType for f in keyed.schema if f.name in by}
    ddl = ", ".join(f"`{c}` {kinds[c].simpleString()}" for c in by) + ", " + schema

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_series(batches, by):
            arrays = [t.column(c).to_numpy().astype(float) for c in dict.fromkeys([*order, *values])]
            got = kernel(*arrays)
            if got is None:
                continue
            got = {k: (v if isinstance(v, (np.ndarray, list)) and not isinstance(v, str) else [v]) for k, v in got.items()}
            n = len(next(iter(got.values())))
            columns = []
            for f in arrow:
                if f.name in got:
                    columns.append(pa.array(got[f.name], type=f.type, from_pandas=True))
                else:
                    columns.append(pa.array([t.column(f.name)[0].as_py()] * n, type=f.type))
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return keyed.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, ddl)
