"""Kernels as table functions of Spark SQL.

After ``register(spark)``:

    SELECT * FROM positions(TABLE(signals) PARTITION BY pair ORDER BY seq, stop => 0.1, fee => 0.001)
    SELECT * FROM signal(TABLE(series) PARTITION BY pair ORDER BY seq, name => 'keltner', window => 20, entry => 2.0)
    SELECT * FROM ema(TABLE(SELECT pair, seq, ratio AS x FROM series) PARTITION BY pair ORDER BY seq, span => 20)

``register_kernel`` makes one of any function of columns, ``register_signal`` of any function of a stretch of bars.
Spark shuffles and sorts the table argument by its PARTITION BY and ORDER BY; batches arrive as Arrow, a
partition's columns are handed to the kernel at once, and its declared columns come back beside key and place.
Settings are named arguments. The schema is declared at registration, so plans are checked before anything runs.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession, functions as F

from . import kernels as K, segments as SG

Kernel = Callable[..., K.Columns]
_ARROW = {"boolean": pa.bool_(), "double": pa.float64(), "long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _plain(value: Any) -> Any:
    """A setting as a Python value."""
    if isinstance(value, (pa.Array, pa.ChunkedArray)):
        value = value[0]
    value = value.as_py() if isinstance(value, pa.Scalar) else value
    return float(value) if type(value).__name__ == "Decimal" else value


def _array(column: pa.ChunkedArray) -> np.ndarray:
    """Flags as booleans, null being false; all else as doubles, null being NaN."""
    if pa.types.is_boolean(column.type):
        return column.fill_null(False).to_numpy()
    return column.cast(pa.float64()).to_numpy().copy()


def _typed(values: np.ndarray, kind: str) -> pa.Array:
    if kind == "double":
        v = np.asarray(values, float)
        return pa.array(v, pa.float64(), mask=~np.isfinite(v))
    return pa.array(np.asarray(values, bool) if kind == "boolean" else values, _ARROW[kind])


def _place(declared: str) -> tuple[str, str]:
    name, _, kind = declared.strip().partition(" ")
    if not kind:
        raise ValueError(f"a column is declared as name and type, not {declared!r}")
    return name, kind


def register_kernel(spark: SparkSession, name: str, kernel: Kernel, inputs: list[str], outputs: dict[str, str], key: str = "pair string", seq: str = "seq int") -> None:
    """``kernel(columns, **settings)`` as the table function ``name``; it returns (key, seq, outputs).

    ``columns`` are the ``inputs`` as arrays in the order of ``seq``; the outputs are as long as they are.
    """
    wrong = [t for t in outputs.values() if t not in _ARROW]
    if wrong:
        raise ValueError(f"no output type {wrong[0]!r}; there are {', '.join(_ARROW)}")
    (by, _), (order, _) = _place(key), _place(seq)
    schema = ", ".join([key, seq, *(f"{k} {t}" for k, t in outputs.items())])

    class Function:
        def __init__(self):
            self.held: list[pa.RecordBatch] = []
            self.settings: dict[str, Any] = {}

        def eval(self, rows, **settings):
            lacking = [c for c in (by, order, *inputs) if c not in rows.schema.names]
            if lacking:
                raise ValueError(f"{name} needs the columns {', '.join(lacking)}")
            self.settings = {k: _plain(v) for k, v in settings.items()}
            self.held.append(rows.select([by, order, *inputs]))

        def terminate(self):
            if not self.held:
                return
            table = pa.Table.from_batches(self.held)
            keys = table[by].unique()
            if len(keys) > 1:
                raise ValueError(f"{name} works on one {by} at a time: say PARTITION BY {by}")
            place = table[order]
            if not (np.diff(place.to_numpy()) > 0).all():
                table = table.sort_by(order)
            made = kernel({c: _array(table[c]) for c in inputs}, **self.settings)
            yield pa.table([table[by], table[order], *(_typed(made[k], t) for k, t in outputs.items())], names=[by, order, *outputs])

    spark.udtf.register(name, F.arrow_udtf(returnType=schema)(Function))


def register_signal(spark: SparkSession, name: str, fn: SG.SegmentSignal, value: str = "ratio", key: str = "pair string", seq: str = "seq int") -> None:
    """A function of (values, window, settings) as ``name``(TABLE ..., window => n, ...): flags that act a bar later."""

    def kernel(columns: K.Columns, window: int = 20, **settings: Any) -> K.Columns:
        go, leave = SG.flags(fn, columns[value], int(window), settings)
        return {"entry": go, "exit": leave}

    register_kernel(spark, name, kernel, [value], {"entry": "boolean", "exit": "boolean"}, key, seq)


def _named_signal(columns: K.Columns, name: str = "zscore_standard", window: int = 20, **settings: Any) -> K.Columns:
    go, leave = SG.flags(SG.segment_signal(name), columns["ratio"], int(window), settings)
    return {"entry": go, "exit": leave}


def _positions(columns: K.Columns, stop: float = 0.0, fee: float = 0.001) -> K.Columns:
    return K.positions(columns["num_close"], columns["entry"], columns["exit"], float(stop), float(fee))


def _of_x(fn: Callable[..., np.ndarray], **kinds: type) -> Kernel:
    """A kernel of the column x; settings are brought to the kinds its arguments need."""
    return lambda columns, **settings: {"y": fn(columns["x"], **{k: kinds[k](v) for k, v in settings.items()})}


#: Kernels of one column x, by the name of the function: each returns y.
OF_X: dict[str, Kernel] = {
    "ema": _of_x(K.ema, span=int, adjust=bool, least=int),
    "kama": _of_x(K.kama, period=int, fast=int, slow=int),
    "rsi_wilder": _of_x(K.rsi_wilder, n=int),
    "atr_close": _of_x(K.atr_close, period=int),
    "adx_close": _of_x(K.adx_close, period=int),
    "kalman_mean": _of_x(K.kalman_mean, q=float, r=float),
    "trailing_rank": _of_x(K.percent_rank, n=int, need=int),
}


def register(spark: SparkSession, key: str = "pair string", seq: str = "seq int") -> list[str]:
    """All functions of this library; their names."""
    register_kernel(spark, "positions", _positions, ["num_close", "entry", "exit"], {"ret": "double", "position": "long", "trade_ret": "double"}, key, seq)
    register_kernel(spark, "signal", _named_signal, ["ratio"], {"entry": "boolean", "exit": "boolean"}, key, seq)
    for name, kernel in OF_X.items():
        register_kernel(spark, name, kernel, ["x"], {"y": "double"}, key, seq)
    return ["positions", "signal", *OF_X]
