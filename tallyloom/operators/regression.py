"""Partial R2 with entity fixed effects and several regressors, from one aggregate of within-entity cross products."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.schema import let

# The codes of prompt formats of the plain variant; anything else is -1.
FORMAT_CODES = {"standard": 0, "cot": 1, "fewshot": 2}


def mapped_codes(value: Column, codes: dict[str, int], other: int = -1) -> Column:
    """Categories by a given table."""
    return F.coalesce(*(F.when(value == k, F.lit(c)) for k, c in codes.items()), F.lit(other)).cast("double")


def category_codes(rows: DataFrame, column: str, code: str, most: int = 10_000) -> DataFrame:
    """Categories numbered from 0 in their order, -1 for null. The categories, with their numbers, are joined back.

    Up to `most` categories are sent to every task, so rows stay where they are and a frequent category is no hot key; more are joined by a shuffle.
    """
    from tallyloom.operators.stats import counted_before

    found = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.lit(1).alias("_one"))
    few = found.limit(most + 1).count() <= most
    known = counted_before(found, column, "_one").select(column, F.col("before").cast("double").alias(code))
    return rows.join(F.broadcast(known) if few else known, column, "left").withColumn(code, F.coalesce(code, F.lit(-1.0)))


def within_products(rows: DataFrame, entity: str, columns: list[str]) -> DataFrame:
    """One row of sums over entities of the cross products of deviations from the entity's means: s_0_0, s_0_1, ..., with n and entities.

    An entity's products are n times its covariances, which partial aggregates merge without cancellation; so no row meets
    its mean in a join or window, and an entity with a third of all rows is no hot key.
    """
    pairs = list(combinations_with_replacement(range(len(columns)), 2))
    products = [(F.covar_pop(columns[i], columns[j]) * F.count("*")).alias(f"s_{i}_{j}") for i, j in pairs]
    return rows.groupBy(entity).agg(F.count("*").alias("n"), *products).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("entities"), *(F.coalesce(F.sum(f"s_{i}_{j}"), F.lit(0.0)).alias(f"s_{i}_{j}") for i, j in pairs))


def explained(products: Column, k: int) -> Column:
    """b' S^-1 b by Cholesky: products are the rows of S over k regressors, each followed by its entry of b, as array<array<double>>.

    Row i of the factor is bound to a lambda variable before row i + 1 names it. A regressor that the earlier ones
    determine (its pivot is nothing beside its own square) adds nothing.
    """
    zero = F.lit(0.0)

    def factor(i: int, done: list[Column]) -> Column:
        if i == k:
            return sum((row[k] * row[k] for row in done), zero)
        own: list[Column] = []
        for j in range(i):
            rest = products[j][i] - sum((own[m] * done[j][m] for m in range(j)), zero)
            own.append(F.when(done[j][j] > 0, rest / done[j][j]).otherwise(zero))
        bound = F.array(*own, zero) if own else F.array(zero)

        def with_row(row: Column) -> Column:
            squares = products[i][i] - sum((row[m] * row[m] for m in range(i)), zero)
            pivot = F.when(squares > 1e-10 * products[i][i], F.sqrt(squares)).otherwise(zero)
            target = products[i][k] - sum((row[m] * done[m][k] for m in range(i)), zero)

            def whole(p: Column) -> Column:
                z = F.when(p > 0, target / p).otherwise(zero)
                return F.array(*(row[m] for m in range(i)), p, *([zero] * (k - i - 1)), z)

            return let(let(pivot, whole), lambda r: factor(i + 1, [*done, r]))

        return let(bound, with_row)

    return factor(0, [])


def sensitivity(rows: DataFrame, entity: str, y: str, regressors: list[str], rho: float = -0.871) -> DataFrame:
    """One row: n, entities, r2_base (entities alone), partial R2 of each regressor alone (partial_<name>) and of all together (partial_all), and the R2 that would overturn rho.

    Rows without a value in any of these columns take no part. Shares of nothing are 0. At most eight regressors, as the
    solution is written out as an expression.
    """
    if not 1 <= len(regressors) <= 8:
        raise ValueError("one to eight regressors")
    columns, k = [*regressors, y], len(regressors)
    used = rows.select(entity, *(F.col(c).cast("double").alias(c) for c in columns)).where(" AND ".join(f"`{c}` IS NOT NULL" for c in [entity, *columns]))
    s = lambda i, j: F.col(f"s_{min(i, j)}_{max(i, j)}")
    total = used.agg((F.var_pop(y) * F.count("*")).alias("total"))
    both = within_products(used, entity, columns).crossJoin(F.broadcast(total))  # one row each
    matrix = F.array(*(F.array(*(s(i, j) for j in range(k)), s(i, k)) for i in range(k)))
    share = lambda part, of: F.greatest(F.lit(0.0), F.coalesce(F.try_divide(part, of), F.lit(0.0)))
    alone = [share(F.try_divide(s(i, k) * s(i, k), s(i, i)), s(k, k)).alias(f"partial_{x}") for i, x in enumerate(regressors)]
    return both.select("n", "entities", F.when(F.col("total") > 0, 1 - s(k, k) / F.col("total")).otherwise(0.0).alias("r2_base"), *alone, share(let(matrix, lambda m: explained(m, k)), s(k, k)).alias("partial_all"), F.lit(rho * rho).alias("overturn"))
