"""SQL access: the engine's tables as temporary views and its distances and kernels as SQL functions.

After ``register`` any statement given to ``spark.sql`` can use them. Functions are SQL themselves, so they are expanded
into the statement's plan and no row leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..functions.columns import by_sort
from ..plans import tables as T

#: The views, and the tables behind them.
VIEWS = {"features": T.features, "histograms": T.histograms, "votes": T.votes, "voxels": T.voxels}

_SUM = "aggregate({}, 0d, (s, e) -> s + e)"
_ONE = "transform({0}, e -> e / aggregate({0}, 0d, (s, e) -> s + e))"


def _zip(body: str) -> str:
    return _SUM.format(f"zip_with(x, y, (a, b) -> {body})")


#: Functions of two vectors of one length by name. The later ones may use the earlier ones.
FUNCTIONS = {
    "dot": _zip("a * b"),
    "l2": f"sqrt({_zip('(a - b) * (a - b)')})",
    "l1": _zip("abs(a - b)"),
    "chi2": _zip("if(a + b = 0, 0d, try_divide((a - b) * (a - b), a + b))") + " / 2",
    "kl": _zip("case when a = 0 then b when b = 0 then double('inf') else a * ln(try_divide(a, b)) - a + b end"),
    "hist": _zip("least(a, b)"),
    "laplace": "exp(-shape_l1(x, y) / size(x))",
    "rbf": "exp(-shape_l2(x, y) * shape_l2(x, y) / size(x))",
    "ks": "aggregate(zip_with(x, y, (a, b) -> a - b), named_struct('run', 0d, 'most', 0d), (s, d) -> named_struct('run', s.run + d, 'most', greatest(s.most, abs(s.run + d)))).most",
    "symkl": _SUM.format(f"zip_with({_ONE.format('transform(x, e -> e + 1e-6d)')}, {_ONE.format('transform(y, e -> e + 1e-6d)')}, (a, b) -> (a - b) * ln(a / b))") + " / size(x)",
    "js": "power(greatest(0d, " + _SUM.format(f"zip_with({_ONE.format('x')}, {_ONE.format('y')}, (a, b) -> if(a > 0, a * ln(try_divide(a, (a + b) / 2)), 0d) + if(b > 0, b * ln(try_divide(b, (a + b) / 2)), 0d))") + " / 2), 0.25d)",
}


def register(spark: SparkSession, sf_dir: str, prefix: str = "shape_") -> None:
    """Make the views ``shape_features``, ``shape_histograms``, ``shape_votes``, ``shape_voxels``, ``shape_vertices`` and
    ``shape_faces`` over the tables in ``sf_dir``, and the functions ``shape_l2``, ``shape_l1``, ``shape_chi2``, ``shape_kl``,
    ``shape_symkl``, ``shape_js``, ``shape_ks``, ``shape_dot``, ``shape_hist``, ``shape_laplace``, ``shape_rbf`` of two vectors, and
    ``shape_combined`` of two histograms and two vectors. Those of the session with these names are replaced."""
    for name, table in VIEWS.items():
        table(spark, sf_dir).createOrReplaceTempView(f"{prefix}{name}")
    for name, table in zip(("vertices", "faces"), T.prisms(spark, sf_dir), strict=True):
        by_sort(table).createOrReplaceTempView(f"{prefix}{name}")
    for name, body in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {prefix}{name}(x array<double>, y array<double>) returns double return {body.replace('shape_', prefix)}")
    spark.sql(f"create or replace temporary function {prefix}combined(hx array<double>, hy array<double>, sx array<double>, sy array<double>) returns double return {prefix}hist(hx, hy) + {prefix}laplace(sx, sy)")
