"""Join operators.

A side is broadcast only after its rows are counted; otherwise Spark chooses, and splits
skewed partitions of the larger side at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from standlab.session import cut_lineage, small_side


def match_nulls(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join in which a null key matches a null key, as a group of null keys is one group.

    For left, inner and semi joins; the key columns are the left side's.  Without keys, the
    right side is the one row of a whole table's totals.
    """
    if not on:
        return left.join(right, how=how)
    mine = {c: f"_right_{c}" for c in on}
    right = right.withColumnsRenamed(mine)
    same = [F.col(c).eqNullSafe(F.col(r)) for c, r in mine.items()]
    out = left.join(right, same, how).drop(*mine.values())
    return out.select(*on, *[c for c in out.columns if c not in on])


def left_join(left: DataFrame, right: DataFrame, on: list[str],
              assert_unique: bool = False, na_matches: bool = False) -> DataFrame:
    """Left equi-join; ``assert_unique`` refuses a right side that would fan rows out, and with
    ``na_matches`` null keys match each other."""
    if assert_unique:
        repeated = right.groupBy(*on).count().filter("count > 1").limit(1).count()
        if repeated:
            raise ValueError(f"right side repeats {on}")
    return match_nulls(left, right, on) if na_matches else left.join(right, on, "left")


def natural_keys(left: DataFrame, right: DataFrame) -> list[str]:
    keys = [c for c in left.columns if c in set(right.columns)]
    if not keys:
        raise ValueError("no shared column")
    return keys


def natural_left(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on every shared column name."""
    return left.join(right, natural_keys(left, right), "left")


def inner_merge(left: DataFrame, right: DataFrame, on: list[str], na_matches: bool = False) -> DataFrame:
    if na_matches:
        return match_nulls(left, right, on, "inner")
    return left.join(right, on, "inner")


def full_merge(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of both sides, matched or not.

    Written as a left join plus the right rows without a partner: Spark can then
    broadcast a small right side or split a hot key, which it cannot in a full join.
    """
    known = left.select(*on).distinct()
    alone = right.join(known, on, "left_anti")
    return left.join(right, on, "left").unionByName(alone, allowMissingColumns=True)


def add_effects(df: DataFrame, effects: list[tuple[DataFrame, list[str], str]],
                out: str = "effect", how: str = "left") -> DataFrame:
    """Look up one effect per level, 0 where a level is unknown, and add them up.

    ``how='full'`` keeps effects no row belongs to as otherwise empty rows.
    """
    for table, keys, col in effects:
        table = small_side(table.select(*keys, col))
        if how == "full":
            df = cut_lineage(df)  # a full merge reads its left side twice: the table of it, not what made it
        df = full_merge(df, table, keys) if how == "full" else df.join(table, keys, "left")
        df = df.fillna(0.0, subset=[col])
    total = sum((F.col(col) for _, _, col in effects), F.lit(0.0))
    return df.withColumn(out, total)


def expand_grid(df: DataFrame, n: int = 100, out: str = "prop") -> DataFrame:
    """Every row times n evenly spaced proportions from 0 to 1."""
    steps = F.sequence(F.lit(0), F.lit(n - 1))
    return (df.withColumn("step", F.explode(steps))
            .withColumn(out, F.col("step") / F.lit(float(n - 1))))


def attach_pure(df: DataFrame, means: DataFrame, value: str, codes: list[str],
                block: str = "block", code: str = "code") -> DataFrame:
    """Attach each block's pure-stand means, one column per pure treatment."""
    wide = (means.filter(F.col(code).isin(codes))
            .groupBy(block).pivot(code, codes).agg(F.avg(value)))
    return df.join(small_side(wide), block, "left")
