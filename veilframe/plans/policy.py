"""Masking policies: which column gets which mask, and who sees the result."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions import fakes, masks, prf, taxonomy
from veilframe.functions.taxonomy import Taxonomy
from veilframe.sources.swap import replace_parquet


@dataclass(frozen=True)
class Site:
    """What a rule may use about the place it is applied to."""

    column: str
    data_type: T.DataType
    key: str
    ident: Column

    @property
    def value(self) -> Column:
        return F.col(self.column)

    def draw(self, part: int = 0) -> Column:
        """Uniform draw of this row for this column; `part` tells several draws apart."""
        return prf.uniform(self.key, self.column, self.ident, part)


Rule = Callable[[Site], Column]


@dataclass(frozen=True)
class Between:
    """Both ends included."""

    column: str
    low: object
    high: object

    def on(self, value: Column) -> Column:
        return value.between(F.lit(self.low), F.lit(self.high))


@dataclass(frozen=True)
class Equals:
    column: str
    value: object

    def on(self, value: Column) -> Column:
        return value == F.lit(self.value)


@dataclass(frozen=True)
class Traceable:
    """A rule that knows which raw values can lead to a masked one.

    `between` and `equals` give a condition on the raw column that every row meets whose
    masked value lies in the range or equals the value, or None if they know none.
    """

    mask: Rule
    between: Callable[[Site, object, object], Column | None] = lambda site, low, high: None
    equals: Callable[[Site, object], Column | None] = lambda site, value: None

    def __call__(self, site: Site) -> Column:
        return self.mask(site)

    def raw(self, site: Site, condition: Between | Equals) -> Column | None:
        if isinstance(condition, Equals):
            return self.equals(site, condition.value)
        return self.between(site, condition.low, condition.high)


@dataclass(frozen=True)
class MaskingPolicy:
    """Column rules plus the roles that see masked values.

    Masks are plain column expressions, so a policy adds no shuffle, and columns
    nobody selects cost nothing. The key is a secret: who has it can rebuild the draws.
    Take another one for each release, `replace(policy, key=...)` for a studied policy.
    """

    rules: Mapping[str, Rule]
    key: str
    ident: str = "id"
    masked_roles: frozenset[str] = field(default_factory=lambda: frozenset({"masked_user"}))

    def apply(self, df: DataFrame) -> DataFrame:
        """The masked projection, columns in their old order."""
        missing = sorted(set(self.rules) - set(df.columns))
        if missing:
            raise ValueError(f"policy names columns the table lacks: {missing}")
        types = {f.name: f.dataType for f in df.schema.fields}
        return df.select(
            *[
                self.rules[c](Site(c, types[c], self.key, F.col(self.ident))).alias(c)
                if c in self.rules
                else F.col(c)
                for c in df.columns
            ]
        )

    def read(self, df: DataFrame, role: str) -> DataFrame:
        """What `role` sees. Filters the caller adds act on the masked values."""
        return self.apply(df) if role in self.masked_roles else df

    def where(
        self, df: DataFrame, *conditions: Between | Equals, role: str | None = None
    ) -> DataFrame:
        """Rows of `read(df, role)`, or of `apply(df)` without a role, that meet all conditions.

        The same rows as a filter on the masked table. A mask hides a filter on its result
        from the scan, so each condition is also turned back to the raw column: a bucket's range
        to the range of its members, a label to its members, a shown prefix to texts that begin
        so. Those reach the scan and skip files and row groups; the condition itself then
        decides. Columns without a mask are filtered as they are.
        """
        if role is not None and role not in self.masked_roles:
            for condition in conditions:
                df = df.where(condition.on(F.col(condition.column)))
            return df
        types = {f.name: f.dataType for f in df.schema.fields}
        few = df
        for condition in conditions:
            rule, raw = self.rules.get(condition.column), None
            if rule is None:
                raw = condition.on(F.col(condition.column))
            elif isinstance(rule, Traceable):
                site = Site(condition.column, types[condition.column], self.key, F.col(self.ident))
                raw = rule.raw(site, condition)
            if raw is not None:
                few = few.where(raw)
        masked = self.apply(few)
        for condition in conditions:
            if condition.column in self.rules:
                masked = masked.where(condition.on(F.col(condition.column)))
        return masked

    def view(self, df: DataFrame, name: str) -> DataFrame:
        """Register the masked projection as a temporary view."""
        masked = self.apply(df)
        masked.createOrReplaceTempView(name)
        return masked

    def store(self, df: DataFrame, path: str) -> DataFrame:
        """Write a masked copy once, in place of an older one, and read it back."""
        return replace_parquet(self.apply(df), path)


# --- rules ------------------------------------------------------------------------------


def _bucket_range(width: int) -> Callable[[Site, object, object], Column]:
    def between(s: Site, low: object, high: object) -> Column:
        if isinstance(s.data_type, T.IntegralType):
            return masks.bucket_between(s.value, width, math.ceil(low), math.floor(high))
        return s.value.between(F.lit(math.floor(low) - width), F.lit(math.ceil(high) + width))

    return between


def bucketed(width: int) -> Rule:
    between = _bucket_range(width)
    return Traceable(
        lambda s: masks.bucket(s.value, width), between, lambda s, value: between(s, value, value)
    )


def generalized(tree: Taxonomy) -> Rule:
    def members(s: Site, label: object) -> Column | None:
        known = tree.groups.get(label, ())
        if tree.trim or label == tree.default:
            return None  # blanks around a member, or any value outside the groups
        if tree.default is None:
            return s.value.isin(*known, label)  # a value in no group keeps its name
        return s.value.isin(*known) if known else F.lit(False)

    return Traceable(lambda s: tree.column(s.value), equals=members)


def sha256() -> Rule:
    return lambda s: masks.sha256_hex(s.value)


def hmac(key: str = masks.HMAC_KEY) -> Rule:
    return lambda s: masks.hmac_sha256_hex(s.value, key)


def partial(prefix: int, keep: tuple[str, ...] = ()) -> Rule:
    def beginning(s: Site, shown: object) -> Column:
        kept = s.value == F.lit(shown) if shown in keep else F.lit(False)
        if not str(shown).endswith("***"):
            return kept
        return kept | s.value.startswith(str(shown)[:-3])

    return Traceable(lambda s: masks.partial(s.value, prefix, keep), equals=beginning)


def suppressed() -> Rule:
    return lambda s: masks.suppress(s.data_type)


def rounded(step: int) -> Rule:
    def between(s: Site, low: object, high: object) -> Column:
        # Halves go away from zero, so a multiple's members lie within half a step of it.
        first, last = math.ceil(low / step) * step, math.floor(high / step) * step
        half = Decimal(step) / 2
        return s.value.between(F.lit(first - half), F.lit(last + half))

    return Traceable(
        lambda s: masks.round_to_step(s.value, step), between, lambda s, value: between(s, value, value)
    )


def truncated(step: int) -> Rule:
    between = _bucket_range(step)
    return Traceable(
        lambda s: masks.truncate_to_step(s.value, step), between, lambda s, value: between(s, value, value)
    )


def proportional(span: float, floor: int = 0) -> Rule:
    return lambda s: masks.proportional_noise(s.value, s.draw(), span, floor)


def additive(width: float, floor: int = 1) -> Rule:
    return lambda s: masks.additive_noise(s.value, s.draw(), width, floor)


def noisy(ratio: float) -> Rule:
    return lambda s: masks.ratio_noise(s.value, s.draw(), ratio, s.data_type)


def random_int(low: int, high: int) -> Rule:
    return lambda s: masks.random_int(s.draw(), low, high)


def fake_list(values: tuple[str, ...]) -> Rule:
    return lambda s: masks.fake_from(values, s.draw())


def fake_name() -> Rule:
    return lambda s: masks.fake_full_name(s.draw(0), s.draw(1))


def fake_company() -> Rule:
    return lambda s: masks.fake_company(s.draw(0), s.draw(1))


def fake_country() -> Rule:
    return lambda s: masks.fake_country(s.draw())


# --- the studied policies -------------------------------------------------------------------

# Fixed value: the key of the studied policies, which are public examples.
STUDY_KEY = "mask-key"

ADULT_VIEW = MaskingPolicy(
    key=STUDY_KEY,
    rules={
        "age": bucketed(5),
        "fnlwgt": sha256(),
        "education": generalized(taxonomy.VIEW_EDUCATION),
        "occupation": partial(3),
        "native_country": generalized(taxonomy.COUNTRY_US_OR_OTHER),
    }
)

HEALTHCARE_VIEW = MaskingPolicy(
    key=STUDY_KEY,
    rules={
        "name": partial(2),
        "age": bucketed(5),
        "doctor": sha256(),
        "billing_amount": rounded(100),
        "room_number": suppressed(),
    }
)

ADULT_RULES = MaskingPolicy(
    key=STUDY_KEY,
    rules={
        "age": random_int(18, 90),
        "fnlwgt": suppressed(),
        "education": fake_list(fakes.FAKE_EDUCATION),
        "occupation": fake_company(),
        "native_country": fake_country(),
        "capital_gain": noisy(0.2),
        "capital_loss": noisy(0.2),
    }
)

HEALTHCARE_RULES = MaskingPolicy(
    key=STUDY_KEY,
    rules={
        "name": fake_name(),
        "age": random_int(18, 90),
        "doctor": fake_name(),
        "room_number": suppressed(),
        "billing_amount": noisy(0.15),
    }
)

# The variants compared with each other; the shuffled one is a job, see plans.variants.
ADULT_HASH = MaskingPolicy(key=STUDY_KEY, rules={"occupation": hmac(), "native_country": hmac()})

ADULT_PARTIAL = MaskingPolicy(
    key=STUDY_KEY,
    rules={"occupation": partial(2, keep=("?",)), "native_country": partial(2)}
)

ADULT_FAKE = MaskingPolicy(key=STUDY_KEY, rules={"occupation": fake_company(), "native_country": fake_country()})

ADULT_NOISE = MaskingPolicy(
    key=STUDY_KEY,
    rules={
        "capital_gain": proportional(0.4),
        "capital_loss": proportional(0.4),
        "hours_per_week": additive(10),
    }
)

ADULT_GENERALIZE = MaskingPolicy(
    key=STUDY_KEY,
    rules={
        "age": bucketed(10),
        "education": generalized(taxonomy.EDUCATION_LEVEL),
        "occupation": generalized(taxonomy.OCCUPATION_CLASS),
        "capital_gain": truncated(1000),
        "capital_loss": truncated(1000),
    }
)
