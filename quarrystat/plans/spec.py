"""What a model is: its outcome, its terms, and how its covariance is estimated."""

from __future__ import annotations

import ast
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTERCEPT = "_cons"


@dataclass(frozen=True)
class Term:
    name: str
    column: Column


@dataclass(frozen=True)
class Spec:
    """``covariance``: nonrobust, HC0, HC1, HC2, HC3, cluster or hac. ``weights``: aweight, fweight or pweight by
    ``weight_type``; pweights make the covariance robust. ``missing``: drop or raise."""

    outcome: str
    predictors: tuple[str, ...]
    covariance: str = "nonrobust"
    cluster: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    intercept: bool = True
    weights: str | None = None
    weight_type: str = "aweight"
    time: str | None = None
    lags: int = 0
    missing: str = "drop"
    alpha: float = 0.05
    options: dict = field(default_factory=dict)


#: Functions that a formula may call.
SCALARS = {"log": F.log, "exp": F.exp, "sqrt": F.sqrt, "abs": F.abs}


def column(node: ast.AST) -> Column:
    """A Column from the syntax tree of an arithmetic expression; only names, numbers, + - * / **, and SCALARS."""
    if isinstance(node, ast.Expression):
        return column(node.body)
    if isinstance(node, ast.Name):
        return F.col(node.id).cast("double")
    if isinstance(node, ast.Constant) and isinstance(node.value, int | float):
        return F.lit(float(node.value))
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
        return -column(node.operand)
    if isinstance(node, ast.BinOp):
        a, b = column(node.left), column(node.right)
        made = {ast.Add: lambda: a + b, ast.Sub: lambda: a - b, ast.Mult: lambda: a * b, ast.Div: lambda: a / b, ast.Pow: lambda: F.pow(a, b)}
        if type(node.op) in made:
            return made[type(node.op)]()
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and len(node.args) == 1:
        if node.func.id == "I":
            return column(node.args[0])
        if node.func.id in SCALARS:
            return SCALARS[node.func.id](column(node.args[0]))
    raise ValueError(f"not allowed in a formula: {ast.dump(node)}")


def expression(text: str) -> Column:
    return column(ast.parse(text.strip().replace("^", "**"), mode="eval"))


def _side(node: ast.AST, source: str) -> tuple[list[str], list[str], bool]:
    """Names of terms, categories, and whether the intercept stays, of the right side of a formula."""
    text = lambda n: ast.get_source_segment(source, n).replace("**", "^").replace("@", ":")
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add | ast.Sub):
        names, categories, stays = _side(node.left, source)
        if isinstance(node.op, ast.Sub):
            if not (isinstance(node.right, ast.Constant) and node.right.value == 1):
                raise ValueError("only the intercept, as - 1, can be taken out of a formula")
            return names, categories, False
        more = _side(node.right, source)
        return names + more[0], categories + more[1], stays and more[2]
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub) and isinstance(node.operand, ast.Constant) and node.operand.value == 1:
        return [], [], False
    if isinstance(node, ast.Constant) and node.value in (0, 1):
        return [], [], node.value == 1
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Mult):
        (left, c1, _), (right, c2, _) = _side(node.left, source), _side(node.right, source)
        singles = [*left, *[f"C({c})" for c in c1]], [*right, *[f"C({c})" for c in c2]]
        return [*left, *right, *[f"{a}:{b}" for a in singles[0] for b in singles[1]]], [*c1, *c2], True
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "C":
        return [], [text(node.args[0])], True
    return [text(node)], [], True


def formula(text: str, **options) -> Spec:
    """``y ~ a + C(b) + a:c + x*C(b) + I(x**2) + I(x + z) + log(z)``; ``- 1`` leaves the intercept out. Products with a
    category take every level but the first."""
    outcome, _, right = text.partition("~")
    source = right.strip().replace("^", "**").replace(":", "@")  # @ binds as tightly as * and isn't used otherwise
    names, categorical, intercept = _side(ast.parse(source, mode="eval").body, source)
    return Spec(outcome.strip(), tuple(dict.fromkeys(n.replace(" @ ", ":").replace(" : ", ":") for n in names)), categorical=tuple(dict.fromkeys(categorical)), intercept=intercept, **options)


def _levels(df: DataFrame, c: str) -> list:
    levels = [r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c).limit(385).collect()]
    if len(levels) > 384:
        raise ValueError(f"{c} has more than 384 levels; absorb it instead")
    return levels


def _coded(c: str, v) -> Term:
    return Term(f"{c}[{v}]", F.when(F.col(c) == F.lit(v), 1.0).otherwise(F.when(F.col(c).isNotNull(), 0.0)))


def terms(df: DataFrame, spec: Spec) -> list[Term]:
    """The design: the predictors, treatment-coded categories (the first level in order is the reference, found
    before rows are dropped), and the intercept."""
    made = []
    levels = {c: _levels(df, c) for c in {*spec.categorical, *[f[2:-1] for p in spec.predictors for f in p.split(":") if f.startswith("C(")]}}
    for p in spec.predictors:
        products = [Term("", F.lit(1.0))]
        for factor in p.split(":"):
            parts = [_coded(factor[2:-1], v) for v in levels[factor[2:-1]][1:]] if factor.startswith("C(") else [Term(factor, expression(factor))]
            products = [Term(f"{a.name}:{b.name}".lstrip(":"), a.column * b.column) for a in products for b in parts]
        made += products
    for c in spec.categorical:
        made += [_coded(c, v) for v in levels[c][1:]]
    return made + [Term(INTERCEPT, F.lit(1.0))] * spec.intercept


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c)


def design(df: DataFrame, spec: Spec, keep: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """y, x0, x1, ..., w (1 without weights) and the columns of ``keep`` for complete rows; the names of the terms."""
    made = terms(df, spec)
    weight = F.col(spec.weights).cast("double") if spec.weights else F.lit(1.0)
    kept = [*dict.fromkeys((*keep, *spec.cluster, *([spec.time] if spec.time else [])))]
    rows = df.select(expression(spec.outcome).alias("y"), *[t.column.cast("double").alias(f"x{i}") for i, t in enumerate(made)], weight.alias("w"), *[F.col(k).alias(f"k_{k}") for k in kept])
    complete = F.lit(True)
    for c in ["y", *[f"x{i}" for i in range(len(made))], "w"]:
        complete = complete & finite(F.col(c))
    for k in kept:
        complete = complete & F.col(f"k_{k}").isNotNull()
    if spec.missing == "raise" and not rows.where(~complete).isEmpty():
        raise ValueError("a used column has missing values")
    return rows.where(complete & (F.col("w") > 0)), [t.name for t in made]
