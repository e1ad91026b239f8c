"""Row functions over pages as Arrow functions whose memory doesn't follow the size of a batch or a table."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows, and characters given to the function, after which results leave the worker.
ROWS, CHARS = 64, 1_000_000


def size_of(value) -> int:
    return len(value) if isinstance(value, str) else 0


def by_row(kind: T.DataType) -> Callable:
    """Makes a function of a row's values one of columns, with results of ``kind`` (structs as dictionaries).

    What arrives stays in Arrow; Python objects are those of a few rows, and results leave in small batches.
    """
    arrow = to_arrow_type(kind)

    def made(function: Callable) -> Callable[..., Column]:
        def run(batches: Iterator) -> Iterator[pa.Array]:
            for whole in batches:
                columns = whole if isinstance(whole, tuple) else (whole,)
                out, chars = [], 0
                for k in range(len(columns[0])):
                    row = [c[k].as_py() for c in columns]
                    out.append(function(*row))
                    chars += sum(map(size_of, row))
                    if len(out) >= ROWS or chars >= CHARS:
                        yield pa.array(out, arrow)
                        out, chars = [], 0
                if out:
                    yield pa.array(out, arrow)

        return functools.update_wrapper(F.arrow_udf(run, kind, F.ArrowUDFType.SCALAR_ITER), function, ("__module__", "__name__", "__qualname__", "__doc__"), ())

    return made
