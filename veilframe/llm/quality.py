"""Text quality by a sparse rule ensemble, compiled into column expressions.

Statistics of a text (shares of capitals, symbols and digits, word and line lengths, shares of
distinct words and lines) are built-in expressions. A random forest of shallow trees over
them gives candidate rules: every path from a root is a conjunction of comparisons. A
logistic regression with lasso penalty over the rules' indicators keeps the few that
matter. The kept rules and their weights become one Spark expression, which scores any
table in place: nothing is shuffled and no Python runs.

Only fitting is bounded: it uses at most `max_labelled` labelled rows, chosen by a hash of
the id. Their ids are therefore few enough to broadcast, and their statistics fit one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import stored_once, unused

MAX_LABELLED = 20_000
THRESHOLD = 0.3


@dataclass(frozen=True)
class Rule:
    """Conjunction of (statistic, is upper bound, value): stat <= value, or stat > value."""

    terms: tuple[tuple[str, bool, float], ...]

    def holds(self, stats: Column | None = None) -> Column:
        out = F.lit(True)
        for name, upper, value in self.terms:
            stat = F.col(name) if stats is None else stats[name]
            out = out & ((stat <= F.lit(value)) if upper else (stat > F.lit(value)))
        return out


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    weights: tuple[tuple[Rule, float], ...]

    def score(self, stats: Column) -> Column:
        """Probability of label 1 from a struct of statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.weights:
            total = total + F.when(rule.holds(stats), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _statistics(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    """Doubles by name; ratios of an empty text are 0."""
    n = F.length(text).cast("double")

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))

    def gone(pattern: str) -> Column:
        return n - F.length(F.regexp_replace(text, pattern, ""))

    def of(mark: str) -> Column:
        return n - F.length(F.replace(text, F.lit(mark), F.lit("")))

    return {
        "log_length": F.log1p(n),
        "capitals": share(gone(r"\p{Lu}+"), n),
        "symbols": share(gone(r"[^\p{L}\p{N}\s.,;:'\"()\-?!|]+"), n),
        "bangs": share(of("!"), n),
        "bars": share(of("|"), n),
        "stops": share(gone(r"[.,;:?]+"), n),
        "digits": share(gone(r"\p{N}+"), n),
        "per_word": share(n, F.size(words)),
        "distinct_words": share(F.size(F.array_distinct(words)), F.size(words)),
        "per_line": share(n, F.size(lines)),
        "distinct_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
    }


STATISTICS = (
    "log_length", "capitals", "symbols", "bangs", "bars", "stops", "digits", "per_word",
    "distinct_words", "per_line", "distinct_lines",
)


def with_statistics(docs: DataFrame, name: str = "_stats") -> DataFrame:
    """`docs` with the statistics of `text` as a struct; a null text counts as empty.

    Words and lines are split once, for all statistics. The one-element explode keeps the
    optimizer from writing a statistic out once for each rule that uses it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words, lines = unused(docs, "_words", "_lines")
    split = docs.withColumns(
        {
            words: F.array_remove(F.split(text, r"\s+"), ""),
            lines: F.array_remove(F.split(text, "\n"), ""),
        }
    )
    stats = _statistics(text, F.col(words), F.col(lines))
    names = dict(zip(stats, unused(docs, *[f"_stat_{n}" for n in stats]), strict=True))
    measured = split.select(*docs.columns, *[c.alias(names[n]) for n, c in stats.items()])
    packed = F.struct(*[F.col(names[n]).alias(n) for n in stats])
    return measured.select(*docs.columns, F.explode(F.array(packed)).alias(name))


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, allowed: Column, max_labelled: int
) -> DataFrame:
    """label and statistics of at most `max_labelled` labelled rows, stored as one file.

    A null text counts as empty. A label counts for every row with its id, rows with a null id or
    label never. Empty tables, or none allowed, give no rows.
    """
    usable = labels.where(allowed & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    chosen = (
        usable.select("doc_id", F.col(label).cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(max_labelled)
        .withColumnRenamed("doc_id", "_id")
    )
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
        .select("label", "doc_id", "text")
    )
    stats = with_statistics(rows).select("doc_id", "label", "_stats.*")
    # Measured where the texts are; only the bounded result goes to one task, in one order.
    return stored_once(
        stats.repartition(1).sortWithinPartitions("doc_id", "label", *STATISTICS), "quality-rows"
    )


def tree_rules(forest) -> list[Rule]:
    """A rule for every path from a root to a node below it, without repeats."""
    found: dict[Rule, None] = {}

    def walk(node, terms: dict[tuple[str, bool], float]) -> None:
        if terms:
            found.setdefault(Rule(tuple((n, u, v) for (n, u), v in sorted(terms.items()))))
        if node.subtreeDepth() == 0:
            return
        split = node.split()
        name, value = STATISTICS[split.featureIndex()], float(split.threshold())
        for upper, child in ((True, node.leftChild()), (False, node.rightChild())):
            old = terms.get((name, upper), value)
            tight = min(old, value) if upper else max(old, value)
            walk(child, terms | {(name, upper): tight})

    for tree in forest.trees:
        walk(tree._call_java("rootNode"), {})
    return list(found)


def fit_ensemble(
    rows: DataFrame, trees: int = 16, depth: int = 3, penalty: float = 1e-3, seed: int = 7
) -> RuleEnsemble:
    """Rules from a forest, weights from a lasso logistic regression on their indicators.

    Rows with one label only, or none at all, give the constant of their label (0.5 for none).
    """
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        constant = {0.0: -4.0, 1.0: 4.0}.get(next(iter(counts), None), 0.0)
        return RuleEnsemble(constant, ())
    assembled = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(rows)
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, maxBins=64, minInstancesPerNode=5, seed=seed,
        featureSubsetStrategy="onethird", subsamplingRate=0.8,
    ).fit(assembled.select("label", "features"))
    rules = tree_rules(forest)
    indicators = rows.select(
        "label", *[r.holds().cast("double").alias(f"r{i}") for i, r in enumerate(rules)]
    )
    ready = VectorAssembler(
        inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features"
    ).transform(indicators).select("label", "features").cache()
    lasso = LogisticRegression(
        elasticNetParam=1.0, regParam=penalty, maxIter=100, standardization=False
    ).fit(ready)
    ready.unpersist()
    weights = [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True)]
    return RuleEnsemble(float(lasso.intercept), tuple((r, w) for r, w in weights if w != 0.0))


def learn(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    allowed: Column | None = None,
    max_labelled: int = MAX_LABELLED,
) -> RuleEnsemble:
    """Ensemble from labelled documents; `allowed` says which rows of `labels` may be used.

    Nulls and repeats as in `training_rows`; other columns are not read. Without labels of both
    kinds the ensemble has no rules, and every score is the share of good labels, or 0.5.
    """
    usable = F.lit(True) if allowed is None else allowed
    return fit_ensemble(training_rows(docs, labels, label, usable, max_labelled))


def score_documents(docs: DataFrame, ensemble: RuleEnsemble) -> DataFrame:
    """`docs` with `score` and `predicted`, in place; columns of these names are replaced.

    Every row gets a score, also with a null or empty text; ids may be null or repeated. An
    empty table gives no rows.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    stats, score = unused(docs, "_stats", "_score")
    scored = with_statistics(docs, stats).withColumn(score, ensemble.score(F.col(stats)))
    return scored.select(
        *kept,
        F.col(score).alias("score"),
        (F.col(score) >= F.lit(THRESHOLD)).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, ensemble: RuleEnsemble) -> DataFrame:
    """Rows of `docs` that the ensemble does not reject, with the columns of `docs`.

    Null and empty texts are judged by their statistics, all 0; rows with equal texts share their
    fate, whatever their ids. An empty table gives no rows.
    """
    (stats,) = unused(docs, "_stats")
    scored = with_statistics(docs, stats)
    return scored.where(ensemble.score(F.col(stats)) >= F.lit(THRESHOLD)).select(*docs.columns)
