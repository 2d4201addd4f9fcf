"""Timings of the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
tables and the cores. Workloads run over stored tables: raw, masked view, stored
masked copy, and a masked role's reading. The systems take turns within each workload, so
none of them runs while code is still compiled for the others. Each figure is the median
of RUNS runs after warm-up; answers are collected, as a client would fetch them.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilframe.catalog import REGISTRY
from veilframe.catalog.base import adult, healthcare, table
from veilframe.plans import policy, workloads
from veilframe.session import build_session, fresh_path, remove_intermediates
from veilframe.sources.layout import write_clustered

RUNS = 5
WARM_UPS = 4
OPERATOR_RUNS = 2
TABLES = ("customer", "part", "orders", "lineitem", "events")

# Registered queries timed from the given tables to the fetched answer.
OPERATORS = (
    "self_join_olap", "distinct_orders_per_part", "param_sweep", "mask_hmac", "mask_fpe",
    "mask_surrogate", "mask_surrogate_four", "surrogate_two_runs", "mask_shuffle", "kanon_publish",
    "synthetic_adult", "policy_static", "policy_where", "exact_sample", "kanon_sweep_lines",
    "kanon_suppress_lines", "kanon_query_utility", "kanon_cardinality_loss", "linkage_attack",
    "linkage_sweep", "dp_accuracy", "dp_count_lines", "mask_comparison", "synthetic_scale",
    "exact_median", "measurement_summary", "csv_round_trip", "csv_quarantine",
    "csv_headerless_numbered", "sampled_variants", "sketched_distinct",
)


def timed(make: Callable[[], DataFrame], runs: int, warm_ups: int) -> float:
    """Median seconds from building the query to its last row, which is not fetched."""
    seconds = []
    for i in range(warm_ups + runs):
        started = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        if i >= warm_ups:
            seconds.append(time.perf_counter() - started)
    return statistics.median(seconds)


def timed_in_turn(makers: dict[str, Callable[[], DataFrame]]) -> dict[str, float]:
    """Median seconds of each query, all of them run once per round."""
    seconds: dict[str, list[float]] = {name: [] for name in makers}
    for i in range(WARM_UPS + RUNS):
        for name, make in makers.items():
            started = time.perf_counter()
            make().collect()
            if i >= WARM_UPS:
                seconds[name].append(time.perf_counter() - started)
    return {name: statistics.median(runs) for name, runs in seconds.items()}


def staged(spark: SparkSession, sf_dir: str) -> str:
    """The given tables as one file per core, the way a loaded table lies in storage."""
    folder = fresh_path(spark, "bench-tables")
    for name in TABLES:
        table(spark, sf_dir, name).repartition(spark.sparkContext.defaultParallelism).write.parquet(
            f"{folder}/{name}.parquet"
        )
    return folder


def stored(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """The table clustered by id, as many files as there are cores."""
    rows = -(-df.count() // spark.sparkContext.defaultParallelism)
    return write_clustered(
        df, fresh_path(spark, label), ["id"], rows_per_file=max(1, rows), rows_per_group=10_000
    )


def workload_queries(people: DataFrame, patients: DataFrame) -> dict[str, Callable[[], DataFrame]]:
    return {
        "point_adult": lambda: workloads.point_lookup(people),
        "point_healthcare": lambda: workloads.point_lookup(patients),
        "range_adult": lambda: workloads.range_count(people),
        "range_healthcare": lambda: workloads.range_avg(patients),
        "groupby_adult": lambda: workloads.top_pairs(people),
        "groupby_healthcare": lambda: workloads.top_pairs(
            patients, ("medical_condition", "gender"), "billing_amount", "patient_count",
            "avg_billing",
        ),
        "distinct_adult": lambda: workloads.distinct_by(
            people, "education", "occupation", "unique_occupations"
        ),
        "distinct_healthcare": lambda: workloads.distinct_by(
            patients, "hospital", "doctor", "doctor_count"
        ),
        "topk_adult": lambda: workloads.top_groups(people),
        "topk_healthcare": lambda: workloads.top_costs(patients),
    }


def scale_factor(folder: str) -> float | str:
    """The number in the folder's name, or the name."""
    name = folder.rstrip("/").rsplit("/", 1)[-1]
    try:
        return float(name.removeprefix("sf"))
    except ValueError:
        return name


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false", spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    results: dict[str, float] = {}

    given = sf_dir
    sf_dir = staged(spark, given)
    people = stored(spark, adult(spark, sf_dir), "bench-adult")
    patients = stored(spark, healthcare(spark, sf_dir), "bench-healthcare")
    systems = {
        "raw": (people, patients),
        "view": (policy.ADULT_VIEW.apply(people), policy.HEALTHCARE_VIEW.apply(patients)),
        "static": (
            stored(spark, policy.ADULT_RULES.apply(people), "bench-adult-static"),
            stored(spark, policy.HEALTHCARE_RULES.apply(patients), "bench-healthcare-static"),
        ),
        "dynamic": (
            policy.ADULT_RULES.read(people, "masked_user"),
            policy.HEALTHCARE_RULES.read(patients, "masked_user"),
        ),
    }
    by_system = {system: workload_queries(*frames) for system, frames in systems.items()}
    for name in next(iter(by_system.values())):
        found = timed_in_turn({system: made[name] for system, made in by_system.items()})
        for system, seconds in found.items():
            results[f"{name}_{system}"] = seconds
            print(f"{name}_{system} {seconds:.3f}", file=sys.stderr)
    for name in OPERATORS:
        run = REGISTRY[name].run
        results[name] = timed(lambda run=run: run(spark, sf_dir), OPERATOR_RUNS, 1)
        print(f"{name} {results[name]:.3f}", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(results.values()), 3),
                "unit": "sec",
                "queries": {k: round(v, 4) for k, v in results.items()},
                "sf": scale_factor(given),
            }
        )
    )
    remove_intermediates(spark)
    spark.stop()


if __name__ == "__main__":
    main()
