"""Generated tables: one row per identifier of any DataFrame, for instance spark.range(n)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions import fakes, prf

# Value ranges and shares of the generated columns.
FIRST_BIRTH_YEAR, BIRTH_YEARS = 1940, 65
GENDER_SHARES = (("M", 0.49), ("F", 0.49), ("O", 0.02))
FIRST_DIAGNOSIS, DIAGNOSES = 100, 899
VISIT_DAYS = 730
LOWEST_VALUE, HIGHEST_VALUE = 100.0, 10_000.0

MAIL_DOMAINS = ("example.com", "example.net", "example.org")
BROWSERS = ("Firefox/128.0", "Chrome/126.0", "Safari/605.1", "Edge/125.0")
PLATFORMS = ("X11; Linux x86_64", "Windows NT 10.0", "Macintosh", "Android 14", "iPhone")


def quasi_identifiers(
    ids: DataFrame, ident: str, end: dt.date, key: str = "gen-key"
) -> DataFrame:
    """Table of quasi-identifiers and one sensitive value; dates in the two years up to `end`."""

    def draw(label: str) -> Column:
        return prf.uniform(key, label, F.col(ident))

    def whole(label: str, low: int, count: int) -> Column:
        return (F.lit(low - 1) + prf.index_below(draw(label), count)).cast("int")

    gender, reached = None, 0.0
    for label, share in GENDER_SHARES[:-1]:
        reached += share
        test = draw("gender") < F.lit(reached)
        gender = F.when(test, label) if gender is None else gender.when(test, label)
    return ids.select(
        F.col(ident).alias("user_id"),
        F.lpad(whole("zip", 0, 100_000).cast("string"), 5, "0").alias("zip_code"),
        whole("birth", FIRST_BIRTH_YEAR, BIRTH_YEARS).alias("birth_year"),
        gender.otherwise(GENDER_SHARES[-1][0]).alias("gender"),
        F.concat(F.lit("D"), whole("diagnosis", FIRST_DIAGNOSIS, DIAGNOSES).cast("string")).alias(
            "diagnosis_code"
        ),
        F.date_sub(F.lit(end), whole("visit", 0, VISIT_DAYS + 1)).alias("visit_date"),
        (F.lit(LOWEST_VALUE) + draw("value") * F.lit(HIGHEST_VALUE - LOWEST_VALUE)).alias(
            "sensitive_value"
        ),
    )


def high_cardinality(
    ids: DataFrame, ident: str, end: dt.datetime, key: str = "gen-key"
) -> DataFrame:
    """Table whose columns hardly repeat a value; times in the two years up to `end`."""

    def draw(label: str, part: int = 0) -> Column:
        return prf.uniform(key, label, F.col(ident), part)

    def whole(label: str, low: int, count: int, part: int = 0) -> Column:
        return (F.lit(low - 1) + prf.index_below(draw(label, part), count)).cast("int")

    code = prf.digest(key, "uuid", F.col(ident))
    uuid = F.concat_ws(
        "-",
        F.substring(code, 1, 8),
        F.substring(code, 9, 4),
        F.concat(F.lit("4"), F.substring(code, 14, 3)),
        F.concat(F.lit("8"), F.substring(code, 18, 3)),
        F.substring(code, 21, 12),
    )
    seconds = VISIT_DAYS * 86_400
    email = F.concat(
        F.lower(prf.pick(fakes.FIRST_NAMES, draw("email"))),
        F.lit("."),
        F.lower(prf.pick(fakes.LAST_NAMES, draw("email", 1))),
        whole("email", 0, 1_000_000, 2).cast("string"),
        F.lit("@"),
        prf.pick(MAIL_DOMAINS, draw("email", 3)),
    )
    octets = [whole("ip", 1, 223), *[whole("ip", 0, 256, part) for part in (1, 2, 3)]]
    return ids.select(
        uuid.alias("uuid"),
        (
            F.lit(end).cast("timestamp_ntz")
            - F.make_dt_interval(secs=whole("time", 0, seconds + 1).cast("decimal(18,6)"))
        ).alias("timestamp"),
        email.alias("email"),
        F.concat_ws(".", *[o.cast("string") for o in octets]).alias("ip_address"),
        F.concat(
            F.lit("Mozilla/5.0 ("),
            prf.pick(PLATFORMS, draw("agent")),
            F.lit(") "),
            prf.pick(BROWSERS, draw("agent", 1)),
        ).alias("user_agent"),
        prf.digest(key, "session", F.col(ident)).alias("session_id"),
        whole("value", 1, 10_000).alias("value"),
    )
