"""Fit once, evaluate on many sets; ablations, grids and shifts as long tables."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators import metrics as M
from threadloom.operators.predictors import Predictor
from threadloom.operators.sampling import first_by_hash
from threadloom.session import staged

SCHEMA = "cell string, test_set string, metric string, value double"


def scored(model: Predictor, rows: DataFrame) -> DataFrame:
    """Predictions beside the truth under the names that the metrics use."""
    p = model.predict(rows).select("record_id", F.col("score").alias("ps"), F.col("width").alias("pw"), F.col("controversiality").alias("pc"))
    t = rows.select("record_id", F.col("score").alias("ts"), F.col("width").alias("tw"), F.col("contr").alias("tc"))
    return staged(p.join(t, "record_id").dropna(), "scored")


def bundle(s: DataFrame, cell: str, test_set: str) -> DataFrame:
    """Point metrics of one cell on one set, long form."""
    c = F.col
    point = s.agg(F.count("*").cast("double").alias("n"), M.mse(c("ps"), c("ts")).alias("score_mse"), M.mae(c("ps"), c("ts")).alias("score_mae"), M.mse(c("pw"), c("tw")).alias("width_mse"), M.mae(c("pw"), c("tw")).alias("width_mae"), M.f1_macro(c("pc"), c("tc")).alias("contr_f1"))
    rho = M.spearman(s, [], "ps", "ts", "score_rho").select("score_rho").crossJoin(M.spearman(s, [], "pw", "tw", "width_rho").select("width_rho"))
    wide = point.crossJoin(rho)
    return wide.select(F.lit(cell).alias("cell"), F.lit(test_set).alias("test_set"), F.explode(F.create_map(*[x for k in wide.columns for x in (F.lit(k), F.col(k).cast("double"))])).alias("metric", "value"))


def sweep(cells: dict[str, Callable[[], Predictor]], train: DataFrame, tests: dict[str, DataFrame]) -> DataFrame:
    """Every cell is fitted once and evaluated on every set."""
    out = None
    for name, make in cells.items():
        model = make().fit(train)
        for test_set, rows in tests.items():
            b = bundle(scored(model, rows), name, test_set)
            out = b if out is None else out.unionByName(b)
    return out if out is not None else train.sparkSession.createDataFrame([], SCHEMA)


def grid_search(make: Callable[..., Predictor], grid: dict[str, list], train: DataFrame, seed: str = "0") -> tuple[dict, float | None]:
    """Best parameters by the mean of both rank correlations on a held-out fifth; the first best wins, undefined ones are left out of the mean."""
    parts = staged(first_by_hash(train, None, seed, "record_id", 0.8), "parts")
    fit, valid = parts.filter("chosen").drop("chosen"), parts.filter("not chosen").drop("chosen")
    best: tuple[dict, float | None] = ({}, None)
    for values in product(*grid.values()):
        params = dict(zip(grid, values))
        s = scored(make(**params).fit(fit), valid)
        rhos = [M.spearman(s, [], a, b).first()["rho"] for a, b in (("ps", "ts"), ("pw", "tw"))]
        known = [r for r in rhos if r is not None]
        value = sum(known) / len(known) if known else None
        if value is not None and (best[1] is None or value > best[1]):
            best = (params, value)
    return best


def scaling(make: Callable[[], Predictor], train: DataFrame, test: DataFrame, fractions: list[float], seed: str = "0") -> DataFrame:
    """The same model refitted on nested shares of the training rows."""
    out = None
    for f in fractions:
        part = first_by_hash(train, None, seed, "record_id", f).filter("chosen").drop("chosen")
        b = bundle(scored(make().fit(part), test), f"{f:g}", "test")
        out = b if out is None else out.unionByName(b)
    return out if out is not None else train.sparkSession.createDataFrame([], SCHEMA)


def report(long: DataFrame) -> str:
    """Markdown table of a long result: a line per cell and set, a column per metric."""
    rows = long.collect()
    names = sorted({r["metric"] for r in rows})
    values = {(r["cell"], r["test_set"], r["metric"]): r["value"] for r in rows}
    show = lambda v: "n/a" if v is None else f"{v:.4g}"
    lines = ["| cell | set | " + " | ".join(names) + " |", "|---|---|" + "---|" * len(names)]
    for cell, s in sorted({k[:2] for k in values}):
        lines.append(f"| {cell} | {s} | " + " | ".join(show(values.get((cell, s, n))) for n in names) + " |")
    return "\n".join(lines)
