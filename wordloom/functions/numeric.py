"""Activation functions and grids over numeric columns."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.operators.ranking import ROWS_PER_RANGE, neighbours


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sigmoid(x: Column | str, beta: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-beta * _col(x)))


def tanh(x: Column | str) -> Column:
    return F.tanh(_col(x))


def relu(x: Column | str) -> Column:
    # greatest() passes over nulls
    return F.when(_col(x).isNotNull(), F.greatest(_col(x), F.lit(0.0)))


def leaky_relu(x: Column | str) -> Column:
    return F.greatest(_col(x), 0.01 * _col(x))


GRID = 64  # points of the error function per unit
EDGE = 6  # beyond which it is 1 in double precision
NODES = np.arange(-EDGE * GRID, EDGE * GRID + 1) / GRID
AT_NODES = np.array([math.erf(x) for x in NODES])
SLOPES = 2 / math.sqrt(math.pi) * np.exp(-NODES * NODES)


def erf(values: np.ndarray) -> np.ndarray:
    """Error function: the nearest point of a grid and the Taylor series around it, which has Hermite polynomials."""
    x = np.clip(values, -EDGE, EDGE)
    place = np.rint(np.nan_to_num(x) * GRID).astype(np.int64) + EDGE * GRID
    node = NODES[place]
    d = x - node
    # derivative k + 1 over that of order 1: h(k + 1) = -2 (x h(k) + k h(k - 1))
    before, now = np.zeros_like(node), np.ones_like(node)
    power, series = d.copy(), np.zeros_like(node)
    for k in range(8):
        series += now * power
        before, now = now, -2 * (node * now + k * before)
        power = power * d / (k + 2)
    return AT_NODES[place] + SLOPES[place] * series


@F.arrow_udf(T.DoubleType())
def _erf(x: pa.Array) -> pa.Array:
    # Spark has no error function
    return pa.array(erf(x.to_numpy(zero_copy_only=False)), mask=np.asarray(x.is_null(nan_is_null=False)))


def gelu(x: Column | str) -> Column:
    """Gaussian-error linear unit."""
    x = _col(x).cast("double")
    return 0.5 * x * (1 + _erf(x / math.sqrt(2)))


def swish(x: Column | str, beta: float = 1.0) -> Column:
    return _col(x) * sigmoid(x, beta)


ACTIVATIONS = {
    "sigmoid": sigmoid,
    "tanh": tanh,
    "relu": relu,
    "leakyrelu": leaky_relu,
    "gelu": gelu,
    "swish": swish,
}


def linspace(spark: SparkSession, start: float, stop: float, n: int, name: str = "x") -> DataFrame:
    """``n`` evenly spaced numbers with both ends, as ``(i, x)``."""
    step = (stop - start) / (n - 1)
    return spark.range(n).select(F.col("id").alias("i"), (F.lit(float(start)) + F.col("id") * F.lit(step)).alias(name))


def gradient(
    df: DataFrame,
    series: list[str],
    x: str,
    y: str,
    name: str = "dydx",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Derivative of y along x per series: second-order differences on an uneven grid
    inside, one-sided differences at the ends. A series of one point has none."""
    placed = neighbours(df, series, x, [x, y], rows_per_range)
    here_x, here_y = F.col(x).cast("double"), F.col(y).cast("double")
    left_x, left_y = F.col("previous")[x].cast("double"), F.col("previous")[y].cast("double")
    right_x, right_y = F.col("next")[x].cast("double"), F.col("next")[y].cast("double")
    hs, hd = here_x - left_x, right_x - here_x
    inside = (hs * hs * right_y + (hd * hd - hs * hs) * here_y - hd * hd * left_y) / (hs * hd * (hs + hd))
    slope = (
        F.when(left_x.isNotNull() & right_x.isNotNull(), inside)
        .when(right_x.isNotNull(), (right_y - here_y) / hd)
        .when(left_x.isNotNull(), (here_y - left_y) / hs)
    )
    return placed.withColumn(name, slope).drop("previous", "next")
