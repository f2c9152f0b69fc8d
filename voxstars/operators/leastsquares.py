"""Least squares from sums that can be added up: one aggregate, exact in any order, solved in closed form.

The sums are decimals, so they do not depend on partitioning; those of new reviews are merged into
stored ones without reading old reviews again. The equations have one row per feature.
"""

from dataclasses import dataclass
from fractions import Fraction
from itertools import combinations_with_replacement

from pyspark.sql import functions as F

from voxstars import schema as S
from voxstars.operators.models import RATING, RATING_FEATURES, clamp_rating

WHOLE, POINT = "decimal(19,0)", "decimal(12,6)"


def product_sums(df, features=RATING_FEATURES, target=S.SCORE):
    """One row: n, s_i, s_i_j, t, t_i, t_t over the rows where everything is known.

    Features are whole numbers; the target is taken to six decimal places.
    """
    known = df.select(
        *[F.col(c).try_cast(WHOLE).alias(f"x{i}") for i, c in enumerate(features)], F.col(target).try_cast(POINT).alias("y")
    ).na.drop()
    k = range(len(features))
    sums = [F.count(F.lit(1)).alias("n"), F.sum("y").alias("t"), F.sum(F.col("y") * F.col("y")).alias("t_t")]
    sums += [F.sum(f"x{i}").alias(f"s_{i}") for i in k]
    sums += [F.sum((F.col(f"x{i}") * F.col("y")).cast("decimal(38,6)")).alias(f"t_{i}") for i in k]
    sums += [F.sum((F.col(f"x{i}") * F.col(f"x{j}")).cast("decimal(38,0)")).alias(f"s_{i}_{j}") for i, j in combinations_with_replacement(k, 2)]
    return known.agg(*sums)


def merge_sums(sums):
    """Rows of ``product_sums`` of several batches into one."""
    return sums.agg(*[F.sum(c).alias(c) for c in sums.columns])


@dataclass(frozen=True)
class LinearModel:
    features: tuple
    intercept: float | None
    coefficients: tuple
    n: int
    r2: float | None

    def rating(self):
        """The prediction as a column expression; null where a feature is missing or nothing was learnt."""
        if self.intercept is None:
            return F.lit(None).cast("double")
        out = F.lit(self.intercept)
        for c, b in zip(self.features, self.coefficients):
            out = out + F.col(c).cast("double") * F.lit(b)
        return out


def solve(row, features=RATING_FEATURES):
    """Model of one row of sums. The equations are solved in fractions, so nothing cancels.

    A feature that is constant or follows from those before it gets the coefficient 0.
    """
    k, n = len(features), int(row["n"] or 0)
    if not n:
        return LinearModel(tuple(features), None, (None,) * k, 0, None)
    get = lambda c: Fraction(row[c])
    s, t = [get(f"s_{i}") for i in range(k)], get("t")
    # Centred: n times the sums of products less the products of sums.
    a = [[n * get(f"s_{min(i, j)}_{max(i, j)}") - s[i] * s[j] for j in range(k)] for i in range(k)]
    b = [n * get(f"t_{i}") - s[i] * t for i in range(k)]
    left = [[*r, v] for r, v in zip(a, b)]
    used = []
    for i in range(k):
        if left[i][i] <= 0:  # what the features before it leave of this one
            continue
        used.append(i)
        for j in range(k):
            if j != i:
                ratio = left[j][i] / left[i][i]
                left[j] = [x - ratio * y for x, y in zip(left[j], left[i])]
    solution = [left[i][k] / left[i][i] if i in used else Fraction(0) for i in range(k)]
    intercept = (t - sum(x * y for x, y in zip(solution, s))) / n
    whole = n * get("t_t") - t * t
    r2 = float(sum(x * y for x, y in zip(solution, b)) / whole) if whole else None
    return LinearModel(tuple(features), float(intercept), tuple(float(x) for x in solution), n, r2)


def fit_least_squares(df, features=RATING_FEATURES, target=S.SCORE):
    return solve(product_sums(df, features, target).first(), features)


def coefficient_table(spark, model):
    """One row per term, the intercept first."""
    rows = [("(intercept)", model.intercept), *zip(model.features, model.coefficients)]
    return spark.createDataFrame(rows, "term string, coefficient double")


def score_least_squares(model, df):
    """Add the predicted stars: rounded half to even, within 1 to 5."""
    return df.withColumn(RATING, clamp_rating(model.rating()))
