"""Linkage attack: how many external people can be found in a masked table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUASI_IDENTIFIERS = ("age", "education", "sex", "race")
# Largest external table that is sent to every executor.
BROADCAST_ROWS = 100_000


_RATES = ("match_rate", "unique_match_rate", "false_match_rate")
_COUNTS = ("total_records", "matched", "unique_matched", "false_matched")


def _null_safe_match(columns: Sequence[str], prefix: str) -> Column:
    condition = F.lit(True)
    for c in columns:
        condition = condition & F.col(c).eqNullSafe(F.col(prefix + c))
    return condition


def _prefixed(df: DataFrame, columns: Sequence[str], prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in columns])


def linkage_sweep(
    external: DataFrame,
    targets: Mapping[str, DataFrame],
    quasi_identifiers: Sequence[str] = QUASI_IDENTIFIERS,
    ident: str = "id",
    external_rows: int | None = None,
) -> DataFrame:
    """One row of counts and rates per target.

    matched: the own id is among the rows with equal quasi-identifiers;
    unique_matched: it is the only such row; false_matched: the only such row is
    somebody else. Rates are over the external rows. A target without the needed
    columns reports zeros and its error.

    External and target rows are never paired within a group: both sides are summed
    per quasi-identifier combination first, and the own ids are matched by id, so a
    huge group costs one counter. All targets go through the same joins together and
    are read once. External ids are unique.
    `external_rows` is a proven upper bound of the external size (a sample of that
    many); if small enough, the external side is broadcast and the targets are
    filtered in place instead of being shuffled.
    """
    qis = list(quasi_identifiers)
    wanted = [ident, *qis]
    failed, narrow = {}, None
    for name, target in targets.items():
        missing = sorted(set(wanted) - set(target.columns))
        if missing:
            failed[name] = f"target {name} lacks {missing}"
            continue
        rows = target.select(F.lit(name).alias("_target"), *_as_text(target, ident, qis))
        narrow = rows if narrow is None else narrow.unionByName(rows)
    results = []
    if narrow is not None:
        names = [n for n in targets if n not in failed]
        people = external.select(*_as_text(external, ident, qis))
        results.append(_attack(people, narrow, names, qis, ident, external_rows))
    for name, problem in failed.items():
        results.append(_failure(external, name, problem))
    if not results:
        raise ValueError("no targets")
    whole = results[0]
    for more in results[1:]:
        whole = whole.unionByName(more)
    return whole


def _as_text(df: DataFrame, ident: str, qis: Sequence[str]) -> list[Column]:
    """Identifier as it is, quasi-identifiers as text that is equal where the values are.

    Masked columns may be of another type. Numbers are written alike whatever their type
    (5, 5.0 and 5.00 are the text 5), so they match across types; a number and a digest
    simply do not.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def plain(name: str) -> Column:
        value = F.col(name)
        if not isinstance(kinds[name], (T.FractionalType, T.DecimalType)):
            return value.cast("string").alias(name)
        real = value.cast("double")
        whole = (real == F.floor(real)) & (F.abs(real) < F.lit(float(2**53)))
        return (
            F.when(whole, real.cast("bigint").cast("string"))
            .otherwise(real.cast("string"))
            .alias(name)
        )

    return [F.col(ident), *[plain(q) for q in qis]]


def _attack(
    people: DataFrame,
    targets: DataFrame,
    names: Sequence[str],
    qis: Sequence[str],
    ident: str,
    external_rows: int | None,
) -> DataFrame:
    known = _prefixed(people, [ident, *qis], "_p_").distinct()
    candidates = targets
    if external_rows is not None and external_rows <= BROADCAST_ROWS:
        # The caller's bound is checked before anything is broadcast.
        found = people.limit(external_rows + 1).count()
        if found > external_rows:
            raise ValueError(f"external table has more than the {external_rows} rows stated")
        known = F.broadcast(known)
        combinations = _prefixed(people.select(*qis).distinct(), qis, "_e_")
        candidates = targets.join(
            F.broadcast(combinations), _null_safe_match(qis, "_e_"), "left_semi"
        )
    own = (F.col(ident) == F.col(f"_p_{ident}")) & _null_safe_match(qis, "_p_")
    zero, one = F.lit(0).cast("bigint"), F.count(F.lit(1))
    target_sizes = (
        candidates.join(known, own, "left")
        .groupBy("_target", *qis)
        .agg(one.alias("rows"), F.count_distinct(f"_p_{ident}").alias("hits"))
    )
    per_target = F.explode(F.array(*[F.lit(n) for n in names])).alias("_target")
    external_sizes = people.groupBy(*qis).agg(one.alias("external"))
    sizes = (
        external_sizes.select(
            per_target, *qis, "external", zero.alias("rows"), zero.alias("hits")
        )
        .unionByName(target_sizes.withColumn("external", zero))
        .groupBy("_target", *qis)
        .agg(*[F.sum(c).alias(c) for c in ("external", "rows", "hits")])
    )
    alone = F.col("rows") == 1
    totals = sizes.groupBy("_target").agg(
        F.sum("external").alias("total_records"),
        F.sum("hits").alias("matched"),
        F.sum(F.when(alone, F.col("hits")).otherwise(zero)).alias("unique_matched"),
        F.sum(F.when(alone, F.col("external") - F.col("hits")).otherwise(zero)).alias(
            "false_matched"
        ),
    )
    rates = [
        F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("total_records")), F.lit(0.0))
        for c in _COUNTS[1:]
    ]
    return totals.select(
        F.col("_target").alias("masking_method"),
        *[rate.alias(name) for rate, name in zip(rates, _RATES)],
        *_COUNTS,
        F.lit(None).cast("string").alias("error"),
    )


def _failure(external: DataFrame, name: str, problem: str) -> DataFrame:
    return external.sparkSession.range(1).select(
        F.lit(name).alias("masking_method"),
        *[F.lit(0.0).alias(c) for c in _RATES],
        *[F.lit(0).cast("bigint").alias(c) for c in _COUNTS],
        F.lit(problem).alias("error"),
    )


def linkage_attack(
    external: DataFrame,
    target: DataFrame,
    name: str,
    quasi_identifiers: Sequence[str] = QUASI_IDENTIFIERS,
    ident: str = "id",
    external_rows: int | None = None,
) -> DataFrame:
    """The sweep's row for a single target; see `linkage_sweep`."""
    return linkage_sweep(external, {name: target}, quasi_identifiers, ident, external_rows)
