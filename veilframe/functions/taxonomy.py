"""Category taxonomies: value -> broader value, with a rule for the rest."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.operators.lookup import lookup_join


@dataclass(frozen=True)
class Taxonomy:
    """`groups` maps each broad label to its members.

    A value in no group becomes `default`; `default=None` keeps it unchanged.
    With `null_is_default` a NULL takes the default as well, as the ELSE branch
    of a CASE does; otherwise NULL stays NULL.
    """

    groups: Mapping[str, tuple[str, ...]]
    default: str | None = None
    null_is_default: bool = True
    trim: bool = False

    def column(self, value: Column) -> Column:
        """The generalized value as one CASE expression."""
        source = F.trim(value) if self.trim else value
        expr = None
        for label, members in self.groups.items():
            test = source.isin(*members)
            expr = F.when(test, F.lit(label)) if expr is None else expr.when(test, F.lit(label))
        rest = source if self.default is None else F.lit(self.default)
        if not self.null_is_default:
            rest = F.when(source.isNotNull(), rest)
        return expr.otherwise(rest) if expr is not None else rest


def generalize_by_table(
    df: DataFrame, column: str, taxonomy: DataFrame, default: str | None
) -> DataFrame:
    """Replace `column` through a (value, label) table, for taxonomies too long for a CASE.

    The table's keys are unique, so the row count stays the same. A category often holds
    half of all rows, so frequent values are looked up in place and only rare ones shuffled.
    """
    counted = df.groupBy(F.col(column).alias("_value")).agg(F.count(F.lit(1)).alias("_rows"))
    labels = taxonomy.select(F.col("value").alias("_value"), F.col("label").alias("_label"))
    rest = F.col(column) if default is None else F.lit(default)
    table = labels.join(counted, "_value")
    joined = lookup_join(
        df.withColumn("_value", F.col(column)), table, ["_value"], "_label", "_rows"
    )
    return joined.select(
        *[
            F.coalesce(F.col("_label"), rest).alias(c) if c == column else F.col(c)
            for c in df.columns
        ]
    )


# Labels and members that results must match.
VIEW_EDUCATION = Taxonomy(
    groups={
        "Some-School": (
            "Preschool", "1st-4th", "5th-6th", "7th-8th", "9th", "10th", "11th", "12th",
        ),
        "HS-Some-College": ("HS-grad", "Some-college"),
    },
)

EDUCATION_LEVEL = Taxonomy(
    groups={
        "Primary": ("Preschool", "1st-4th", "5th-6th", "7th-8th"),
        "High-School": ("9th", "10th", "11th", "12th", "HS-grad"),
        "College": ("Some-college", "Assoc-voc", "Assoc-acdm", "Bachelors"),
        "Graduate": ("Masters", "Prof-school", "Doctorate"),
    },
    default="Other",
)

# The taxonomy used before k-anonymity differs in one level, 7th-8th.
KANON_EDUCATION = Taxonomy(
    groups={
        "Primary": ("Preschool", "1st-4th", "5th-6th"),
        "Middle": ("7th-8th",),
        "High-School": ("9th", "10th", "11th", "12th", "HS-grad"),
        "College": ("Some-college", "Assoc-voc", "Assoc-acdm", "Bachelors"),
        "Graduate": ("Masters", "Prof-school", "Doctorate"),
    },
    default="Other",
    null_is_default=False,
    trim=True,
)

OCCUPATION_CLASS = Taxonomy(
    groups={
        "Professional": ("Exec-managerial", "Prof-specialty"),
        "Office": ("Tech-support", "Sales", "Adm-clerical"),
        "Skilled-Labor": ("Craft-repair", "Machine-op-inspct", "Transport-moving"),
        "Service": ("Handlers-cleaners", "Farming-fishing", "Other-service"),
        "Other": ("Priv-house-serv", "Protective-serv", "Armed-Forces"),
    },
    default="Unknown",
)

COUNTRY_US_OR_OTHER = Taxonomy(groups={"United-States": ("United-States",)}, default="Other")
