"""Mix sources to target weights by words, with DataFrame functions only.

The words of a source form one stream, its documents in a keyed order, cut into blocks
of `block_words`. Sources share the total by weight; a target stops at `max_repeats`
times the source, and the excess is shared again among the others (water filling: with
level L a source gets min(weight * L, cap)). A source gives out its stream in epochs: each
epoch visits all blocks in a pseudorandom order of their indexes (a swap-or-not
permutation, computed per slot, nothing is sorted), and the last one stops at the target.
The mix is written in output shards of `shard_slots` slots. For each shard the sources' counts
are a multinomial draw with the targets' shares: every slot draws its source by a keyed hash.
A source's draws, shard after shard, take the slots of its sequence in turn. What a
source is drawn more often than its sequence has slots, at the end of the mix, goes to sources
drawn too seldom, so the totals meet the targets. Slots and document pieces are joined by
(source, block index).

Sums run in two levels: within buckets of some thousand documents, then over the buckets
of a source, so a source with most rows does not end in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilframe.llm.common import stored_once, unused

# Fixed value: what separates words, ASCII white space as the mix counts it.
WORD = r"[^\x20\x09-\x0D]+"
WORD_WITH_SPACE = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
BLOCK_WORDS = 256
# Slots of an output shard; the last one may have fewer.
SHARD_SLOTS = 1024
_SHARDS_PER_TASK = 64
# Cells of a table of ranges: a number is looked up in its cell, where few ranges are.
_CELLS = 4096
_ROUNDS = 16


def words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_repeats: int = 3
) -> DataFrame:
    """(source, source_no, source_size, weight, target) per source.

    Sources by code point, null last, take the weights in turn. The windows here and in
    `drawn_slots` run over one row a source in one task: right for any number of sources, and
    cheap up to some millions.
    """
    numbered = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn(
            "source_no",
            F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - F.lit(1),
        )
        .withColumn(
            "weight",
            F.element_at(
                F.array(*[F.lit(float(w)) for w in weights]),
                (F.col("source_no") % F.lit(len(weights)) + 1).cast("int"),
            ),
        )
        .withColumn("_cap", (F.col("source_size") * max_repeats).cast("double"))
    )
    everything = W.partitionBy()
    by_ratio = W.orderBy(F.col("_cap") / F.col("weight"), "source_no")
    capped = (
        numbered.withColumn("_all", F.sum("source_size").over(everything).cast("double"))
        .withColumn("_all_weight", F.sum("weight").over(everything))
        .withColumn("_cap_here", F.sum("_cap").over(by_ratio.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn(
            "_weight_here", F.sum("weight").over(by_ratio.rowsBetween(W.unboundedPreceding, 0))
        )
        # The level if this source and all with smaller caps per weight stop at their caps.
        .withColumn(
            "_level",
            F.try_divide(
                F.col("_all") - (F.col("_cap_here") - F.col("_cap")),
                F.col("_all_weight") - (F.col("_weight_here") - F.col("weight")),
            ),
        )
    )
    free = F.col("_level") * F.col("weight") <= F.col("_cap")
    # The first source in this order that stays below its cap sets the level.
    ratio = F.struct(F.col("_cap") / F.col("weight"), F.col("source_no"))
    leveled = capped.withColumn(
        "_l", F.min_by(F.col("_level"), F.when(free, ratio)).over(everything)
    )
    return leveled.select(
        "source",
        F.col("source_no").cast("int").alias("source_no"),
        "source_size",
        "weight",
        F.coalesce(F.least(F.col("weight") * F.col("_l"), F.col("_cap")), F.col("_cap")).alias(
            "target"
        ),
    )


def permuted(index: Column, n: Column, key: Column, inverse: bool = False) -> Column:
    """Image of `index` in a keyed permutation of 0..n-1, or the index of an image.

    Swap-or-not rounds: each pairs x with (k - x) mod n and swaps the pair or not by a keyed
    bit of its larger member. A round is its own inverse, so the whole is a bijection for
    every n, and the same rounds in reverse order undo it.
    """

    def swap(x: Column, i: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, i), n) - x, n)
        bit = F.xxhash64(key, i, F.greatest(x, partner)).bitwiseAND(F.lit(1))
        return F.when(bit == 1, partner).otherwise(x)

    order = range(_ROUNDS - 1, -1, -1) if inverse else range(_ROUNDS)
    rounds = F.array(*[F.lit(i) for i in order])
    return F.aggregate(rounds, index.cast("bigint"), swap)


def _with_slots(targets: DataFrame, block_words: int, seed: int) -> DataFrame:
    """(source_no, slots) of the sources that are taken from: the length of their sequences."""
    key = F.xxhash64(F.lit(seed), "source_no", F.col("epochs").alias("epoch"))
    # Where the short block comes in the last epoch; later slots begin that much earlier.
    short = permuted(F.col("blocks") - 1, F.col("blocks"), key, inverse=True)
    full = F.ceil(F.col("rest") / F.lit(block_words))
    beyond = F.ceil((F.col("rest") + block_words - F.col("last_block")) / F.lit(block_words))
    through = F.col("_short") + 1
    last = F.least(full, through) + F.greatest(F.lit(0), F.least(beyond, F.col("blocks")) - through)
    return (
        targets.where("blocks > 0")
        .withColumn("_short", short)
        .select(
            "source_no",
            (F.col("epochs") * F.col("blocks") + F.when(F.col("rest") > 0, last).otherwise(F.lit(0)))
            .cast("bigint")
            .alias("slots"),
        )
        .where("slots > 0")
    )


def _looked_up(rows: DataFrame, value: str, ranges: DataFrame, total: int) -> DataFrame:
    """`rows` with the columns of the range [_lo, _hi) that holds `value`, which is below `total`.

    A join by cell: a range stands in the cells it touches, at most `_CELLS` more rows in all.
    """
    width = F.lit(max(1, -(-total // _CELLS)))
    cells = ranges.where(F.col("_lo") < F.col("_hi")).withColumn(
        "_cell",
        F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor((F.col("_hi") - 1) / width))),
    )
    return (
        rows.withColumn("_cell", F.floor(F.col(value) / width))
        .join(cells, "_cell")
        .where((F.col(value) >= F.col("_lo")) & (F.col(value) < F.col("_hi")))
        .drop("_cell")
    )


def drawn_slots(sequences: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """shard, place, source_no, slot: every slot of the mix, and which of a source's it is.

    `sequences` has source_no and slots. There are as many slots as sequences hold in all,
    dealt to shards of `shard_slots`. Each draws its source with the chance of the source's
    share, so the sources' counts in a shard are multinomial.
    """
    spark = sequences.sparkSession
    total = sequences.agg(F.sum("slots")).first()[0] or 0
    earlier = W.orderBy("source_no").rowsBetween(W.unboundedPreceding, -1)

    def ranges(table: DataFrame, count: str) -> DataFrame:
        low = F.coalesce(F.sum(count).over(earlier), F.lit(0))
        return table.withColumn("_lo", low).withColumn("_hi", F.col("_lo") + F.col(count))

    tasks = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    )
    # A stated number of tasks: by their bytes these few rows would be put into one.
    shards = spark.range(0, -(-total // shard_slots), 1, tasks).withColumnRenamed("id", "shard")
    filled = F.least(F.lit(shard_slots), F.lit(total) - F.col("shard") * shard_slots)
    places = shards.withColumn(
        "place", F.explode(F.sequence(F.lit(0).cast("bigint"), filled - 1))
    ).withColumn(
        "_draw", F.pmod(F.xxhash64(F.lit(seed + 1), "shard", "place"), F.lit(max(1, total)))
    )
    drawn = stored_once(
        _looked_up(places, "_draw", ranges(sequences, "slots"), total).select(
            "shard", "place", "source_no", "slots"
        ),
        "mix-draws",
    )
    counts = drawn.groupBy("source_no", "shard").agg(F.count(F.lit(1)).alias("_count"))
    before = W.partitionBy("source_no").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    # Both are read several times below. Written, they keep the plans, which the driver holds and
    # plans anew after every stage, small.
    bases = stored_once(
        counts.select(
            F.col("source_no").alias("_source"),
            F.col("shard").alias("_shard"),
            "_count",
            F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_base"),
        ),
        "mix-bases",
    )
    within = W.partitionBy("shard", "source_no").orderBy("place")
    ranked = stored_once(
        drawn.withColumn("_nth", F.row_number().over(within) - 1)
        .join(bases, (F.col("source_no") == F.col("_source")) & (F.col("shard") == F.col("_shard")))
        .select("shard", "place", "source_no", "slots", (F.col("_base") + F.col("_nth")).alias("slot")),
        "mix-ranked",
    )
    # Draws beyond a source's sequence, numbered over all sources, fill the sequences not full.
    found = bases.groupBy("_source").agg(F.sum("_count").alias("_drawn"))
    balance = stored_once(
        sequences.join(found, F.col("source_no") == F.col("_source"), "left").select(
            "source_no", "slots", F.coalesce("_drawn", F.lit(0)).alias("_drawn")
        ),
        "mix-balance",
    )
    surplus = ranges(
        balance.withColumn("_over", F.greatest(F.lit(0), F.col("_drawn") - F.col("slots"))), "_over"
    ).select(F.col("source_no").alias("_source"), F.col("_lo").alias("_first"))
    lacking = ranges(
        balance.withColumn("_under", F.greatest(F.lit(0), F.col("slots") - F.col("_drawn"))), "_under"
    ).select(F.col("source_no").alias("_to"), "_lo", "_hi", F.col("_drawn").alias("_had"))
    over = (
        ranked.where(F.col("slot") >= F.col("slots"))
        .join(surplus, F.col("source_no") == F.col("_source"))
        .withColumn("_draw", F.col("_first") + F.col("slot") - F.col("slots"))
    )
    moved = _looked_up(over, "_draw", lacking, total).select(
        "shard",
        "place",
        F.col("_to").alias("source_no"),
        (F.col("_had") + F.col("_draw") - F.col("_lo")).alias("slot"),
    )
    return ranked.where(F.col("slot") < F.col("slots")).select(
        "shard", "place", "source_no", "slot"
    ).unionByName(moved)


def row_key(seed: int) -> Column:
    """Keyed hash of a row: its place in its source's stream, wherever the row is stored."""
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source"), F.col("text"))


def mix_plan(
    docs: DataFrame,
    seed: int = 0,
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    max_repeats: int = 3,
    block_words: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS,
    bucket_rows: int = 1024,
) -> tuple[DataFrame, DataFrame]:
    """(placed, pieces).

    placed: doc_id, size, source_no, source_size, target, row, start: each row of `docs` at
    its place in its source's stream; `row` tells apart rows with equal ids.
    pieces: doc_id, source_no, row, start, size, epoch, lo, hi, slot, shard, place: words
    [lo, hi) of a document that a slot of the mix takes. `slot` is its rank in the source's
    sequence, `place` where it stands in its output shard.

    Uses doc_id, text and source. Null text has no words; such rows are placed, without
    pieces. Null sources form a source of their own. Equal rows are rows of their own. An
    empty table gives empty tables. The output depends on the rows alone, not on files.
    """
    sizes = stored_once(
        docs.select(
            "doc_id",
            "source",
            words(F.col("text")).alias("size"),
            row_key(seed).alias("row"),
        ),
        "mix-sizes",
    )
    targets = stored_once(
        source_targets(sizes, weights, max_repeats)
        .withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block_words)))
        .withColumn(
            "epochs",
            F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)),
        )
        .withColumn(
            "rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + 1e-6)
        )
        .withColumn(
            "last_block",
            F.col("source_size") - (F.col("blocks") - 1) * F.lit(block_words),
        ),
        "mix-targets",
    )
    rows = sizes.agg(F.count(F.lit(1)).alias("n")).scalar()
    # About as many buckets as rows in one, so neither level of the sums grows faster.
    buckets = F.ceil(rows / F.greatest(F.lit(float(bucket_rows)), F.sqrt(rows)))
    numbered = targets.select(F.col("source").alias("_source"), "source_no")
    bucketed = (
        sizes.join(numbered, F.col("source").eqNullSafe(F.col("_source")))
        .select("doc_id", "source_no", "size", "row")
        .withColumn("bucket", F.pmod(F.col("row"), F.greatest(F.lit(1), buckets)))
    )
    earlier = W.partitionBy("source_no").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = (
        bucketed.groupBy("source_no", "bucket")
        .agg(F.sum("size").alias("_words"))
        .select(
            "source_no",
            "bucket",
            F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_base"),
        )
    )
    within = (
        W.partitionBy("source_no", "bucket")
        .orderBy("row", "doc_id", "size")
        .rowsBetween(W.unboundedPreceding, -1)
    )
    placed = stored_once(
        bucketed.withColumn("_before", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(bases, ["source_no", "bucket"])
        .select(
            "doc_id", "source_no", "size", "row", (F.col("_base") + F.col("_before")).alias("start")
        ),
        "mix-placed",
    )

    # Slots: shard and place there -> source and rank in its sequence -> epoch, block, words.
    key = F.xxhash64(F.lit(seed), "source_no", "epoch")
    short_rank = permuted(F.col("blocks") - 1, F.col("blocks"), key, inverse=True)
    drawn = drawn_slots(_with_slots(targets, block_words, seed), shard_slots, seed)
    ranked = (
        drawn.join(targets.drop("source", "weight", "target"), "source_no")
        .withColumn("epoch", F.floor(F.col("slot") / F.col("blocks")))
        .withColumn("rank", F.col("slot") - F.col("epoch") * F.col("blocks"))
        .withColumn("_short_rank", short_rank)
        .withColumn("block", permuted(F.col("rank"), F.col("blocks"), key))
    )
    before = F.col("rank") * F.lit(block_words) - F.when(
        F.col("_short_rank") < F.col("rank"), F.lit(block_words) - F.col("last_block")
    ).otherwise(F.lit(0))
    length = F.when(F.col("block") == F.col("blocks") - 1, F.col("last_block")).otherwise(
        F.lit(block_words)
    )
    taken = F.when(F.col("epoch") < F.col("epochs"), length).otherwise(
        F.least(length, F.greatest(F.lit(0), F.col("rest") - before))
    )
    # Written, so that joins know how many there are.
    slots = stored_once(
        ranked.withColumn("taken", taken).select(
            "source_no", "block", "epoch", "slot", "taken", "shard", "place"
        ),
        "mix-slots",
    )
    end = F.col("start") + F.col("size")
    parts = (
        placed.where(F.col("size") > 0)
        .withColumn(
            "block",
            F.explode(
                F.sequence(
                    F.floor(F.col("start") / F.lit(block_words)),
                    F.floor((end - 1) / F.lit(block_words)),
                )
            ),
        )
        .withColumn("_from", F.greatest(F.col("block") * block_words, F.col("start")))
    )
    stop = F.least(end, F.col("block") * block_words + F.col("taken"))
    pieces = (
        parts.join(slots, ["source_no", "block"])
        .where(stop > F.col("_from"))
        .select(
            "doc_id",
            "source_no",
            "row",
            "start",
            "size",
            "epoch",
            (F.col("_from") - F.col("start")).alias("lo"),
            (stop - F.col("start")).alias("hi"),
            "slot",
            "shard",
            "place",
        )
    )
    facts = targets.select("source_no", "source_size", "target")
    return placed.join(facts, "source_no"), pieces


def taken_words(placed: DataFrame, pieces: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken per row of the corpus; `mix_plan` has the cases.

    Rows without words, null texts among them, have a taken of 0. Empty tables give no rows.
    """
    counts = pieces.groupBy("source_no", "start", "row").agg(
        F.sum(F.col("hi") - F.col("lo")).alias("_taken")
    )
    # Rows without words share a start with others, so only rows with words are joined.
    joined = placed.join(
        counts.select(*[F.col(k).alias(f"_{k}") for k in ("source_no", "start", "row")], "_taken"),
        (F.col("source_no") == F.col("_source_no"))
        & (F.col("start") == F.col("_start"))
        & (F.col("row") == F.col("_row"))
        & (F.col("size") > 0),
        "left",
    )
    return joined.select(
        "doc_id", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).alias("taken")
    )


def mixed_documents(
    docs: DataFrame, seed: int = 0, shard: str | None = None, **settings
) -> DataFrame:
    """The mixed corpus, with the columns of `docs`: a row per document and epoch it is taken in.

    Rows come shard by shard, in the order of their first words there; a column `shard` is added
    if a name for it is given. So each stretch of the output has the drawn mix of sources.

    A document taken whole keeps its text; one taken in part keeps the words of the parts,
    each with the white space that follows it. `n_chars`, where there is one, is counted
    anew. Rows not taken are left out, and so are rows without words.
    """
    plan, pieces = mix_plan(docs, seed, **settings)
    # Tasks get some shards each, about a hundred megabytes of text, however large the mix is.
    slot_words = settings.get("block_words", BLOCK_WORDS) * settings.get("shard_slots", SHARD_SLOTS)
    shards = -(-(plan.agg(F.sum("size")).first()[0] or 0) // slot_words)
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(shards, least), -(-shards // _SHARDS_PER_TASK))
    spans = pieces.groupBy("row", "doc_id", "start", "epoch", "size").agg(
        F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"),
        F.min(F.struct("shard", "place", "lo")).alias("first"),
    )
    row, copy, use_row, use_id, uses, start, use, first = unused(
        docs, "_row", "_copy", "_use_row", "_use_id", "_uses", "_start", "_use", "_first"
    )
    found = spans.groupBy(F.col("row").alias(use_row), F.col("doc_id").alias(use_id)).agg(
        F.collect_list(F.struct("start", "epoch", "size", "spans", "first")).alias(uses)
    )
    starts = F.array_sort(F.array_distinct(F.col(f"{uses}.start")))
    # Equal rows have one key and different starts: the n-th such row takes the n-th start.
    numbered = docs.withColumn(row, row_key(seed)).withColumn(
        copy, F.row_number().over(W.partitionBy(row).orderBy("doc_id"))
    )
    used = (
        numbered.join(
            found, (F.col(row) == F.col(use_row)) & F.col("doc_id").eqNullSafe(F.col(use_id))
        )
        .withColumn(start, F.try_element_at(starts, F.col(copy).cast("int")))
        .withColumn(use, F.explode(F.filter(uses, lambda u: u["start"] == F.col(start))))
    )
    tokens = F.regexp_extract_all("text", F.lit(WORD_WITH_SPACE), F.lit(0))
    parts = F.transform(
        F.col(f"{use}.spans"),
        lambda s: F.array_join(F.slice(tokens, s["lo"] + 1, s["hi"] - s["lo"]), ""),
    )
    taken = F.aggregate(
        F.col(f"{use}.spans"),
        F.lit(0).cast("bigint"),
        lambda n, s: n + s["hi"] - s["lo"],
    )
    text = F.when(taken == F.col(f"{use}.size"), F.col("text")).otherwise(F.array_join(parts, ""))
    out = used.withColumn("text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.length("text").cast(kind))
    own = docs.columns if shard is None else [*docs.columns, shard]
    placed = out.withColumn(first, F.col(f"{use}.first"))
    if shard is not None:
        placed = placed.withColumn(shard, F.col(f"{first}.shard"))
    return (
        placed.select(*own, first)
        .repartition(tasks, F.col(f"{first}.shard"))
        .sortWithinPartitions(first, F.col("doc_id"))
        .select(*own)
    )
