"""Queries on trees and forests, with SQL for the first split by trying all of them, on missing values and on categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystat.operators import categories, imputation, trees
from quarrystat.operators.linear import ols
from quarrystat.plans.basic import estimates, query, rounded
from quarrystat.plans.spec import Spec
from quarrystat.sources.tables import small, table


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with an outcome that depends on quantity and discount."""
    d = table(spark, sf, "lineitem")
    y = F.col("l_extendedprice") / 10_000 + F.when(F.col("l_quantity") > 30, 4.0).otherwise(0.0) + F.when((F.col("l_quantity") > 30) & (F.col("l_discount") > 0.045), 3.0).otherwise(0.0)
    return d.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"), y.alias("y"), F.col("l_returnflag").alias("f"))


LINES = """l AS (SELECT l_quantity AS q, l_discount AS d, l_tax AS t, l_extendedprice / 10000 + CASE WHEN l_quantity > 30 THEN 4.0 ELSE 0 END + CASE WHEN l_quantity > 30 AND l_discount > 0.045 THEN 3.0 ELSE 0 END AS y FROM lineitem)"""


def _best(source: str) -> str:
    """The split of ``source`` that saves most of the squares, by all values of each predictor."""
    return f"""SELECT predictor, edge, saved FROM (
    SELECT predictor, (x + lead(x) OVER w) / 2 AS edge, a * a / n + (ta - a) ** 2 / (tn - n) - ta * ta / tn AS saved FROM (
      SELECT predictor, x, sum(sum(y)) OVER v AS a, sum(count(*)) OVER v AS n, sum(sum(y)) OVER u AS ta, sum(count(*)) OVER u AS tn
      FROM (SELECT 'q' AS predictor, q AS x, y FROM {source} UNION ALL SELECT 'd', d, y FROM {source} UNION ALL SELECT 't', t, y FROM {source}) GROUP BY predictor, x
      WINDOW v AS (PARTITION BY predictor ORDER BY x), u AS (PARTITION BY predictor)) WHERE tn > n OR true WINDOW w AS (PARTITION BY predictor ORDER BY x)
    ) WHERE edge IS NOT NULL ORDER BY saved DESC LIMIT 1"""


@query(f"""WITH {LINES}, r AS ({_best("l")}), up AS (SELECT l.* FROM l, r WHERE CASE predictor WHEN 'q' THEN q WHEN 'd' THEN d ELSE t END > edge), s AS ({_best("up")})
SELECT 'first' AS split, predictor, round(edge, 6) AS edge FROM r UNION ALL SELECT 'above it', predictor, round(edge, 6) FROM s""")
def tree_splits(spark, sf):
    tree = trees.cart(_lines(spark, sf), "y", ["q", "d", "t"], depth=2)
    above = tree.left[0] + 1
    rows = [(name, tree.predictors[tree.feature[n]], round(tree.edge[n], 6)) for name, n in (("first", 0), ("above it", above))]
    return small(spark, rows, "split string, predictor string, edge double")


@query()
def tree_nodes(spark, sf):
    return rounded(trees.describe(spark, trees.pruned(trees.cart(_lines(spark, sf), "y", ["q", "d", "t"], depth=4, least=50), 200.0)), 3)


@query()
def tree_classes(spark, sf):
    rows = _lines(spark, sf)
    learn, test = trees.prediction_split(rows, 0.7, keys=["l_orderkey"])
    tree = trees.cart(learn.withColumn("k", F.when(F.col("y") > 8, "high").otherwise("low")), "k", ["q", "d", "t"], kind="class", depth=4, least=20)
    judged = trees.cart_predict(test.withColumn("k", F.when(F.col("y") > 8, "high").otherwise("low")), tree)
    return judged.groupBy("k", "prediction").agg(F.count(F.lit(1)).alias("n"))


@query()
def causal_forest_effects(spark, sf):
    rows = _lines(spark, sf).withColumn("w", (F.col("f") == "R").cast("double"))
    rows = rows.withColumn("y", F.col("y") + F.col("w") * F.when(F.col("q") > 25, 2.0).otherwise(0.0))
    forest = trees.causal_forest(rows, "y", "w", ["q", "d", "t"], trees=20, depth=3, keys=["l_orderkey", "l_linenumber"])
    found = trees.causal_predict(rows, forest).groupBy((F.col("q") > 25).alias("large")).agg(F.avg("effect").alias("effect"), F.count("effect").alias("n"))
    return rounded(found, 2)


def _missing(spark: SparkSession, sf: str) -> DataFrame:
    """Prices and quantities of lines; the price is missing in one line of three with a large quantity, tax in others."""
    d = table(spark, sf, "lineitem")
    price = F.col("l_extendedprice") / 1000 + F.col("l_quantity")
    return d.select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), F.when(~((F.col("l_quantity") > 30) & (F.col("l_orderkey") % 3 == 0)), price).alias("p"),
        F.when(F.col("l_partkey") % 4 != 0, F.col("l_tax") * 100 + price / 10).alias("t"),
    )


@query("""WITH l AS (SELECT l_quantity AS q, CASE WHEN NOT (l_quantity > 30 AND l_orderkey % 3 = 0) THEN l_extendedprice / 1000 + l_quantity END AS p FROM lineitem),
c AS (SELECT regr_slope(p, q) AS b, regr_intercept(p, q) AS a, (regr_syy(p, q) - regr_slope(p, q) * regr_sxy(p, q)) / regr_count(p, q) AS v FROM l), m AS (SELECT avg(q) AS q, var_pop(q) AS v FROM l)
SELECT 'q' AS a, NULL AS b, round(m.q, 4) AS value FROM m UNION ALL SELECT 'p', NULL, round(a + b * q, 4) FROM c, m UNION ALL SELECT 'q', 'q', round(m.v, 4) FROM m UNION ALL SELECT 'q', 'p', round(b * m.v, 4) FROM c, m UNION ALL SELECT 'p', 'p', round(c.v + b * b * m.v, 4) FROM c, m""")
def missing_normal_em(spark, sf):
    return rounded(imputation.normal_em(_missing(spark, sf), ["q", "p"]).frame(spark), 4)


@query()
def missing_general_em(spark, sf):
    return rounded(imputation.normal_em(_missing(spark, sf), ["q", "p", "t"]).frame(spark), 3)


@query()
def missing_at_random_test(spark, sf):
    return rounded(imputation.missing_at_random(_missing(spark, sf), ["q", "p", "t"]).drop("p_value"), 2)


@query()
def imputed_regression(spark, sf):
    made = imputation.impute(_missing(spark, sf), ["q", "p", "t"], ["l_orderkey", "l_linenumber"], imputations=5)
    fits = [ols(made.where(F.col("imputation") == m), Spec("p", ("q", "t"))) for m in range(1, 6)]
    return estimates(imputation.pooled(fits), spark, 2)


def _kinds(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem")
    return d.select(F.col("l_returnflag").alias("flag"), F.floor(F.col("l_quantity") / 20).cast("int").alias("amount"), F.floor((F.col("l_quantity") + 60 * F.col("l_discount")) / 14).cast("int").alias("score"))


@query("""WITH k AS (SELECT CAST(floor(l_quantity / 20) AS INTEGER) AS a, CAST(floor((l_quantity + 60 * l_discount) / 14) AS INTEGER) AS b FROM lineitem), n AS (SELECT count(*) AS n FROM k),
t AS (SELECT a, b, count(*) AS o FROM k GROUP BY ALL), r AS (SELECT a, count(*) AS r FROM k GROUP BY ALL), c AS (SELECT b, count(*) AS c FROM k GROUP BY ALL)
SELECT CAST(max(n.n) AS DOUBLE) AS n, round(sum((coalesce(o, 0) - r * c / n.n::DOUBLE) ** 2 / (r * c / n.n::DOUBLE)) / max(n.n), 8) AS inertia FROM r CROSS JOIN c CROSS JOIN n LEFT JOIN t USING (a, b)""")
def correspondence_inertia(spark, sf):
    fit = categories.correspondence(_kinds(spark, sf), "amount", "score")
    return small(spark, [(fit.n, round(fit.total, 8))], "n double, inertia double")


@query()
def correspondence_coordinates(spark, sf):
    return rounded(categories.correspondence(_kinds(spark, sf), "amount", "score").frame(spark), 6)


@query("""WITH k AS (SELECT l_returnflag AS f, floor(l_quantity / 20) AS a, floor((l_quantity + 60 * l_discount) / 14) AS s FROM lineitem) SELECT CAST((count(DISTINCT f) + count(DISTINCT a) + count(DISTINCT s)) AS INTEGER) AS categories, round((count(DISTINCT f) + count(DISTINCT a) + count(DISTINCT s)) / 3.0 - 1, 8) AS total FROM k""")
def multiple_correspondence_total(spark, sf):
    fit = categories.multiple(_kinds(spark, sf), ["flag", "amount", "score"])
    return small(spark, [(len(fit.levels), round(fit.total, 8))], "categories int, total double")


@query()
def multiple_correspondence_scores(spark, sf):
    rows = _kinds(spark, sf)
    scored = categories.project(rows, categories.multiple(rows, ["flag", "amount", "score"]), 1)
    return rounded(scored.groupBy("amount").agg(F.avg("axis1").alias("axis1"), F.count(F.lit(1)).alias("n")), 6)
