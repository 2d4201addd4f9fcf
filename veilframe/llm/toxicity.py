"""Toxicity by class-conditional Kneser-Ney models of spelt words.

Each word is spelt character by character after a start mark; the context of a character is
the word so far, or its last `order` characters where it is longer (insults are inflected,
so parts of a word carry more than its whole form). Two models, of toxic and of ordinary text, are
estimated with absolute discounting from counts by class, in documents, so that one text
repeating a word counts once. Both back off to one shared model of the pooled counts, which in
turn backs off to continuation counts: over the last two characters, a context counts once
for each different spelling it ends. Discounts follow from how many spellings occur once
and twice. Rare expressions thus cost both classes nearly the same.

The log-ratio of a word is the difference of its two log-likelihoods, all characters
included. Ratios of rare words are noisy, and one word tells little of its neighbours'. Hence
* ratios are calibrated by labelled texts that were not counted: among words of about the
  same ratio and the same support (counts of the word's rarest spelling), how much more often
  do toxic texts hold one than ordinary ones;
* toxic text is ordinary text with toxic expressions in it, so its likelihood mixes both
  models: a word adds log(1 - e + e * calibrated ratio), e the share of `expressions`.
Every word counts, mild ones a little. A text's score is the sum over its different words
divided by their number (and a little more, so that one word cannot decide a text of
a few); a logistic curve turns it into a probability.

Counts cover every labelled document that may be learnt from, and scoring uses all spellings:
the model stays a table, which is joined to the different words of the corpus, and their values
to the texts. Frequent contexts and words are broadcast with their values, so that no join
key is hot; that changes where a value is looked up, not which values count.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import stored_once

# Longest context. Of 6,948 held-out texts 5, 6 and 7 got 2, 5 and 3 wrong with 10,000 labelled
# texts counted, of 1,344 they got 18, 13 and 12 wrong with 2,000; 5 needs a quarter of the contexts.
ORDER = 5
# Share of a toxic text's words that are toxic expressions.
EXPRESSIONS = 0.01
# Words added to a length, so that one word cannot decide a text of a few words.
_PADDING = 50
THRESHOLD = 0.7
_START, _END = "\x02", "\x03"
_EDGES = "".join(map(chr, (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)))) + "¡¿«»“”„‘’…"
_HELD_ENTRIES = 300_000
# A context with at least this share of all spelt characters is looked up in place, and a word
# with at least this share of all words: there are at most a million of each.
_HOT_CONTEXTS, _HOT_WORDS = 1e-6, 1e-6
# Values are added as whole billionths of a nat, so sums do not depend on their order.
_UNIT = 1e-9
_OUT_ROWS = 50_000
# Calibration: bins of half a nat, and of doubled support; what smooths a bin's counts.
_BIN = 0.5
_LOWEST, _HIGHEST = -20, 40
_POOLED_TEXTS, _ORDINARY_TEXTS = 100.0, 0.5


def heads(word: str, order: int = ORDER) -> list[str]:
    """The spellings of a word: each character but the start mark after its context."""
    spelt = _START + word + _END
    return [spelt[max(0, k - order - 1) : k] for k in range(2, len(spelt) + 1)]


def words_of(text: str | None) -> set[str]:
    """The different lower-case words, without punctuation at their edges."""
    words = {w.strip(_EDGES) for w in set((text or "").lower().split())}
    words.discard("")
    return words


def _counted(spell):
    """A function over batches that counts `spell(word)` for each text's different words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(table: dict[str, list[int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(table), pa.string()),
                 pa.array([v[0] for v in table.values()], pa.int64()),
                 pa.array([v[1] for v in table.values()], pa.int64())],
                ["head", "ordinary", "toxic"],
            )

        table: dict[str, list[int]] = {}
        for batch in batches:
            for label in (0, 1):
                words: Counter[str] = Counter()
                for text, given in zip(batch["text"], batch["label"].to_pylist(), strict=True):
                    if given == label:
                        words.update(words_of(text.as_py()))
                for word, n in words.items():
                    for head in spell(word):
                        table.setdefault(head, [0, 0])[label] += n
            if len(table) > _HELD_ENTRIES:
                yield out(table)
                table = {}
        if table:
            yield out(table)

    return count


def _label_counts(labelled: DataFrame, spell) -> DataFrame:
    rows = labelled.select("text", "label").mapInArrow(
        _counted(spell), "head string, ordinary bigint, toxic bigint"
    )
    return rows.groupBy("head").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def head_counts(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """head, ordinary, toxic: different words of a text spelt so, by the text's label."""
    return _label_counts(labelled, lambda word: heads(word, order))


def word_counts(labelled: DataFrame) -> DataFrame:
    """entry, ordinary, toxic: how many texts of each label have the word."""
    return _label_counts(labelled, lambda word: [word]).withColumnRenamed("head", "entry")


def discounts(counts: DataFrame) -> dict[str, float]:
    """What each model takes off a count: n1 / (n1 + 2 n2), of spellings that occur once and twice."""
    columns = {"ordinary": F.col("ordinary"), "toxic": F.col("toxic"), "pooled": F.col("ordinary") + F.col("toxic")}
    row = counts.agg(
        *[F.count_if(c == n).alias(f"{name}{n}") for name, c in columns.items() for n in (1, 2)]
    ).first()
    out = {}
    for name in columns:
        once, twice = row[f"{name}1"], row[f"{name}2"]
        # Without spellings that occur once the estimate is 0, which would leave no mass.
        out[name] = max(0.1, once / (once + 2 * twice)) if once + twice else 0.5
    return out


def model(counts: DataFrame) -> DataFrame:
    """context, uses, backoff, chars: per context, its characters' ratio and pooled count.

    A ratio is log p_toxic - log p_ordinary of the character given the context; `backoff` is
    that of a character neither class has seen there: both back off to one shared model, so only
    the masses they leave to it differ. Both in billionths of a nat. A context has at most as
    many characters as there are in the alphabet.
    """
    taken = discounts(counts)
    spelt = counts.select(
        "ordinary",
        "toxic",
        (F.col("ordinary") + F.col("toxic")).alias("pooled"),
        F.expr("substring(head, 1, length(head) - 1)").alias("context"),
        F.expr("right(head, 1)").alias("char"),
        F.expr("right(head, 3)").alias("tail"),
    )
    # Continuation counts: distinct spellings by their last three characters.
    tails = (
        spelt.groupBy("tail")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.expr("substring(tail, 1, length(tail) - 1)"))
    )
    befores = tails.groupBy("_before").agg(F.sum("_n").alias("_of"))
    continued = tails.join(befores, "_before").select(
        "tail", (F.col("_n") / F.col("_of")).alias("continued")
    )
    grouped = (
        spelt.join(continued, "tail")
        .groupBy("context")
        .agg(
            F.collect_list(F.struct("char", *taken, "continued")).alias("rows"),
            *[F.sum(c).alias(f"_{c}_all") for c in taken],
            *[F.sum(F.least(F.col(c), F.lit(d))).alias(f"_{c}_cut") for c, d in taken.items()],
        )
    )

    def p(row: Column, name: str, lower: Column) -> Column:
        seen = F.greatest(row[name] - taken[name], F.lit(0.0))
        known = (seen + F.col(f"_{name}_cut") * lower) / F.col(f"_{name}_all")
        return F.when(F.col(f"_{name}_all") > 0, known).otherwise(lower)

    def in_units(value: Column) -> Column:
        return F.round(value / _UNIT).cast("bigint")

    def entry(row: Column) -> Column:
        shared = p(row, "pooled", row["continued"])
        ratio = F.log(p(row, "toxic", shared)) - F.log(p(row, "ordinary", shared))
        return F.struct(row["char"], F.struct(in_units(ratio).alias("ratio"), row["pooled"].alias("n")))

    def left(name: str) -> Column:
        mass = F.log(F.col(f"_{name}_cut") / F.col(f"_{name}_all"))
        return F.when(F.col(f"_{name}_all") > 0, mass).otherwise(F.lit(0.0))

    return grouped.select(
        "context",
        F.col("_pooled_all").alias("uses"),
        in_units(left("toxic") - left("ordinary")).alias("backoff"),
        F.map_from_entries(F.transform("rows", entry)).alias("chars"),
    )


def corpus_words(docs: DataFrame) -> DataFrame:
    """entry, texts: every different word in `docs` and how many texts have it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(table), pa.string()), pa.array(list(table.values()), pa.int64())],
                ["entry", "texts"],
            )

        table: Counter[str] = Counter()
        for batch in batches:
            for text in batch["text"]:
                table.update(words_of(text.as_py()))
                if len(table) > _HELD_ENTRIES:
                    yield out()
                    table.clear()
        if table:
            yield out()

    rows = docs.select("text").mapInArrow(count, "entry string, texts bigint")
    return rows.groupBy("entry").agg(F.sum("texts").alias("texts"))


@dataclass(frozen=True)
class _Hot:
    """Frequent contexts with all their spellings, by 64-bit hashes in order."""

    spellings: np.ndarray
    ratios: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    backoffs: np.ndarray


def _hash(text: str) -> int:
    """What Spark's xxhash64 gives for a string, unsigned."""
    return xxhash.xxh64_intdigest(text.encode(), 42)


def _hot_spellings(spellings: DataFrame) -> _Hot:
    """The table of contexts that hold a stated share of all characters, so a bounded one."""

    def columns(rows: DataFrame) -> list[np.ndarray]:
        table = rows.toArrow()
        found = [table[c].to_numpy() for c in table.column_names]
        order = np.argsort(found[0].view(np.uint64))
        return [found[0].view(np.uint64)[order], *(x[order] for x in found[1:])]

    each = spellings.select("context", F.explode("chars").alias("char", "value"))
    hashed = F.xxhash64(F.concat("context", "char"))
    known, ratios, counts = columns(each.select(hashed.alias("h"), "value.ratio", "value.n"))
    contexts, backoffs = columns(spellings.select(F.xxhash64("context").alias("h"), "backoff"))
    return _Hot(known, ratios, counts, contexts, backoffs)


def _places(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the ordered table, whether it is there) of each wanted hash."""
    if len(table) == 0:
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return at, table[at] == wanted


def word_ratios(
    entries: DataFrame, spellings: DataFrame, order: int = ORDER, hot_share: float = _HOT_CONTEXTS
) -> DataFrame:
    """entry, texts, ratio, support: log-ratio of each word, and the count of its rarest spelling.

    `spellings` is a stored `model`. A character after a context that no labelled text has adds
    nothing; a spelling none has gives a support of 0. Characters after frequent contexts are
    added up in place, the others by a join.
    """
    total = spellings.agg(F.sum("uses")).first()[0] or 0
    is_hot = F.col("uses") >= F.lit(hot_share * total)
    hot = spellings.sparkSession.sparkContext.broadcast(_hot_spellings(spellings.where(is_hot)))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = hot.value
        for batch in batches:
            idents = batch["id"].to_numpy()
            spelt = [heads(word, order) for word in batch["entry"].to_pylist()]
            lengths = np.array([len(x) for x in spelt], dtype=np.int64)
            flat = [head for word in spelt for head in word]
            owner = np.repeat(np.arange(len(spelt)), lengths)
            at, found = _places(table.spellings, np.fromiter(map(_hash, flat), np.uint64, len(flat)))
            ratios = np.where(found, table.ratios[at] if len(table.ratios) else 0, 0)
            counts = np.where(found, table.counts[at] if len(table.counts) else 0, 0)
            missed = np.flatnonzero(~found)
            hashes = np.fromiter((_hash(flat[i][:-1]) for i in missed.tolist()), np.uint64, len(missed))
            at, known = _places(table.contexts, hashes)
            if known.any():
                ratios[missed[known]] = table.backoffs[at[known]]
            is_open = missed[~known]
            counts[is_open] = np.iinfo(np.int64).max  # the join has its count
            sums = np.zeros(len(spelt), dtype=np.int64)
            np.add.at(sums, owner, ratios)
            least = np.full(len(spelt), np.iinfo(np.int64).max, dtype=np.int64)
            np.minimum.at(least, owner, counts)
            none = [None] * len(is_open)
            # A row for each open spelling, and one for each word under a name that spreads and
            # no context has.
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([idents, idents[owner[is_open]]])),
                 pa.array([*(f"\n{i}\n" for i in idents.tolist()), *(flat[i] for i in is_open.tolist())], pa.string()),
                 pa.array([*sums.tolist(), *none], pa.int64()),
                 pa.array([*least.tolist(), *none], pa.int64())],
                ["id", "_spelling", "sum", "least"],
            )

    numbered = stored_once(
        entries.withColumn("id", F.monotonically_increasing_id()), "toxicity-corpus-words"
    )
    rows = numbered.select("id", "entry").mapInArrow(
        spell, "id bigint, _spelling string, sum bigint, least bigint"
    )
    rest = spellings.where(~is_hot).select("context", "backoff", "chars")
    context = F.expr("substring(_spelling, 1, length(_spelling) - 1)")
    known = F.col("chars")[F.expr("right(_spelling, 1)")]
    own = F.col("sum").isNotNull()
    sums = (
        rows.join(rest.hint("merge"), context == F.col("context"), "left")
        .groupBy(F.col("id").alias("_of"))
        .agg(
            F.sum(F.coalesce("sum", known["ratio"], "backoff", F.lit(0))).alias("ratio"),
            F.min(F.when(own, F.col("least")).otherwise(F.coalesce(known["n"], F.lit(0)))).alias("support"),
        )
    )
    return numbered.join(sums, F.col("id") == F.col("_of")).select("entry", "texts", "ratio", "support")


def _bins() -> tuple[Column, Column]:
    ratio = F.round(F.col("ratio") * F.lit(_UNIT / _BIN))
    ratio = F.greatest(F.lit(_LOWEST), F.least(F.lit(_HIGHEST), ratio)).cast("int")
    return ratio.alias("ratio_bin"), F.ceil(F.log2(F.col("support") + 1)).cast("int").alias("support_bin")


def calibrated(
    bins: list[tuple[int, int, int, int]], expressions: float = EXPRESSIONS
) -> dict[tuple[int, int], float]:
    """What a word of each bin adds to a text, from (ratio bin, support bin, ordinary, toxic).

    The counts are of held-out texts that have such a word, summed over the words. A bin
    without texts adds nothing, nor does any if one class has no texts.
    """
    ordinary, toxic = sum(b[2] for b in bins), sum(b[3] for b in bins)
    out = {}
    for ratio, support, no, yes in bins:
        value = 0.0
        if ordinary and toxic and no + yes:
            share = (no + yes) / (ordinary + toxic)
            often = (yes + _POOLED_TEXTS * share) / (toxic + _POOLED_TEXTS)
            seldom = (no + _ORDINARY_TEXTS) / (ordinary + _POOLED_TEXTS)
            value = math.log(1 - expressions + expressions * often / seldom)
        out[ratio, support] = value
    return out


def word_values(
    ratios: DataFrame, held_out: DataFrame, expressions: float = EXPRESSIONS
) -> DataFrame:
    """entry, texts, value: what each word adds to a text, in billionths of a nat.

    `ratios` is a stored `word_ratios`, `held_out` the `word_counts` of texts not counted before.
    There are as many bins as half nats in 30 and doublings of a count: a few thousand at most.
    """
    rows = (
        ratios.join(held_out, "entry")
        .groupBy(*_bins())
        .agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))
    )
    found = calibrated(sorted(tuple(r) for r in rows.collect()), expressions)
    schema = "_ratio_bin int, _support_bin int, value bigint"
    table = [(r, s, round(v / _UNIT)) for (r, s), v in sorted(found.items())]
    values = ratios.sparkSession.createDataFrame(table, schema)
    same = (F.col("ratio_bin") == F.col("_ratio_bin")) & (F.col("support_bin") == F.col("_support_bin"))
    return (
        ratios.select("entry", "texts", *_bins())
        .join(F.broadcast(values), same, "left")
        .select("entry", "texts", F.coalesce("value", F.lit(0)).alias("value"))
    )


def with_ratio(docs: DataFrame, values: DataFrame, hot_share: float = _HOT_WORDS) -> DataFrame:
    """doc_id, ratio: the mean value of a row's different words; 0 without words.

    `values` holds all words of `docs`. Those with `hot_share` of all words are added up in
    place, the others by a join in which no key is hot. A task looks at equal texts once.
    """
    total = values.agg(F.sum("texts")).first()[0] or 0
    often = values.where(F.col("texts") >= F.lit(hot_share * total)).select("entry", "value").toArrow()
    hot = dict(zip(often["entry"].to_pylist(), often["value"].to_pylist(), strict=True))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        names = ["id", "entry", "words", "sum", "key"]

        def out() -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names
            )

        rows: list[tuple] = []
        seen: set[bytes] = set()
        ident = TaskContext.get().partitionId() << 33
        for batch in batches:
            for key, text in zip(batch["key"].to_pylist(), batch["text"], strict=True):
                if key is None or key in seen:
                    continue
                if len(seen) >= _HELD_ENTRIES:
                    seen.clear()
                seen.add(key)
                words = words_of(text.as_py())
                place = 0
                for word in words:
                    value = hot.get(word)
                    if value is None:
                        rows.append((ident, word, None, None, None))
                    else:
                        place += value
                # One row for the text itself, under a name that spreads and no word has.
                rows.append((ident, f"\n{ident}", len(words), place, key))
                ident += 1
                if len(rows) >= _OUT_ROWS:
                    yield out()
                    rows.clear()
        if rows:
            yield out()

    # A text has a number where its words are looked up, numbers being smaller than hashes.
    # Equal texts share a key, and sums that several tasks have found for one are equal.
    keyed = docs.select("doc_id", "text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"))
    rows = keyed.select("key", "text").mapInArrow(
        parts, "id bigint, entry string, words bigint, sum bigint, key binary"
    )
    rest = values.where((F.col("texts") < F.lit(hot_share * total)) & (F.col("value") != 0))
    sums = (
        rows.join(rest.select("entry", "value").hint("merge"), "entry", "left")
        .groupBy("id")
        .agg(
            F.sum(F.coalesce("value", "sum", F.lit(0))).alias("_sum"),
            F.max("words").alias("_words"),
            F.max("key").alias("key"),
        )
        .groupBy("key")
        .agg(F.max("_sum").alias("_sum"), F.max("_words").alias("_words"))
    )
    ratio = F.col("_sum") * F.lit(_UNIT) / (F.col("_words") + F.lit(_PADDING))
    return keyed.select("doc_id", "key").join(sums.hint("merge"), "key", "left").select(
        "doc_id", F.coalesce(ratio, F.lit(0.0)).alias("ratio")
    )


def logistic(bins: list[tuple[float, float, float]], steps: int = 100) -> tuple[float, float]:
    """(intercept, slope) of a logistic curve over (x, weight of 0, weight of 1), lightly damped."""
    if not bins:
        return 0.0, 0.0
    x, no, yes = np.array(bins, dtype=float).T
    scale = max(float(np.sqrt(np.average(x * x, weights=no + yes))), 1e-9)
    design = np.stack([np.ones_like(x), x / scale], axis=1)
    theta = np.zeros(2)
    damp = np.diag([1e-3, 1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (yes - (no + yes) * p) - damp @ theta
        hessian = (design * ((no + yes) * p * (1 - p))[:, None]).T @ design + damp
        step = np.linalg.solve(hessian, gradient)
        theta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1] / scale)


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    allowed: Column | None = None,
    order: int = ORDER,
) -> DataFrame:
    """doc_id, score, predicted of every row of `docs`; labels learnt from `allowed` rows only.

    `allowed` is an expression over doc_id. Of those, three quarters are counted, and one
    quarter calibrates the words' ratios and fits the curve. Null and empty texts score as texts without evidence. Rows keep
    null and repeated ids; a label counts for every row with its id. Without labels of both
    kinds every score is the share of toxic labels, or 0.5. An empty table gives no rows.
    """
    usable = F.lit(True) if allowed is None else allowed
    counted = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fold")), F.lit(4)) > 0
    given = labels.where(usable & F.col("toxic").isin(0, 1)).select(
        F.col("doc_id"), F.col("toxic").cast("int").alias("label")
    )
    texts = docs.select("doc_id", "text")
    # Always a merge join: labels grow with the corpus, and one plan serves every size.
    labelled = texts.where(usable & counted).join(given.where(counted).hint("merge"), "doc_id")
    checked = texts.where(usable & ~counted).join(given.where(~counted).hint("merge"), "doc_id")
    counts = stored_once(head_counts(labelled, order), "toxicity-counts")
    spellings = stored_once(model(counts), "toxicity-model")
    ratios = stored_once(
        word_ratios(corpus_words(texts), spellings, order), "toxicity-words"
    )
    scored = stored_once(
        with_ratio(texts, word_values(ratios, word_counts(checked))), "toxicity-ratios"
    )
    fitted = scored.where(usable & ~counted).join(given.where(~counted), "doc_id")
    # Bins of a hundred-thousandth; beyond 0.2 the curve is flat: at most 25,001 rows.
    place = F.round(F.greatest(F.lit(-0.05), F.least(F.lit(0.2), F.col("ratio"))), 5)
    bins = fitted.groupBy(place.alias("x")).agg(
        F.sum(1 - F.col("label")).alias("no"), F.sum("label").alias("yes")
    )
    found = sorted((r.x, float(r.no), float(r.yes)) for r in bins.collect())
    intercept, slope = logistic(found)
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(intercept) + F.lit(slope) * F.col("ratio"))))
    return scored.select(
        "doc_id", score.alias("score"), (score >= F.lit(THRESHOLD)).cast("int").alias("predicted")
    )
