"""Find secrets by an incremental ledger of content-addressed blobs, DataFrame functions only.

A blob is a text under its SHA-256. However many paths and versions hold it, it is scanned
once per rule set version; findings go to the ledger, a table of (blob, rules_version,
findings). A later run scans only pairs of blob and rules version the ledger lacks and
joins findings back to every row.

Spans come from built-in functions: a text's matches and the pieces between them have known
lengths, so their running sum gives each match's place in code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import stored_once, unused


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern without empty matches, and what a match must satisfy."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


# The base rules, in their order, and well-known token formats.
ASSIGN = (
    r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
RULES = (
    Rule("assign", ASSIGN, group=2, least=6, base=True),
    # Runs are matched whole, so a least length inside the pattern finds the same runs.
    Rule("access", r"AKIA[A-Z0-9]{16,}", least=20, base=True),
    Rule("hex", r"[0-9a-f]{24,}", least=24, base=True),
    # The whole key: up to its end line, or without one as far as the encoded lines go.
    Rule(
        "private_key",
        r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[A-Za-z0-9+/=:,.\x20\x09\x0D\x0A-]*?"
        r"-----END [A-Z ]{0,40}PRIVATE KEY-----|[A-Za-z0-9+/=\x0D\x0A]*)",
    ),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)


def rules_version(rules: Sequence[Rule]) -> str:
    """A name that changes with any rule."""
    return hashlib.sha256(repr(tuple(rules)).encode()).hexdigest()[:16]


def spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, stop, ord, kind>> of the rule's matches that are long enough."""
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    kept = matches if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    between = F.split(text, rule.pattern, -1)
    lengths = F.zip_with(
        F.slice(between, 1, F.size(matches)),
        F.arrays_zip(matches.alias("whole"), kept.alias("kept")),
        lambda gap, m: F.struct(
            F.length(gap).cast("bigint").alias("gap"),
            F.length(m["whole"]).cast("bigint").alias("width"),
            F.length(m["kept"]).cast("bigint").alias("held"),
        ),
    )
    empty = F.array().cast("array<struct<start:bigint,stop:bigint,held:bigint>>")

    def place(state: Column, x: Column) -> Column:
        start = state["pos"] + x["gap"]
        stop = start + x["width"]
        found = F.struct(start.alias("start"), stop.alias("stop"), x["held"].alias("held"))
        return F.struct(
            stop.alias("pos"), F.concat(state["found"], F.array(found)).alias("found")
        )

    placed = F.aggregate(
        lengths,
        F.struct(F.lit(0).cast("bigint").alias("pos"), empty.alias("found")),
        place,
        lambda state: state["found"],
    )
    enough = F.filter(placed, lambda f: f["held"] >= F.lit(rule.least))
    found = F.transform(
        enough,
        lambda f: F.struct(
            f["start"].alias("start"),
            f["stop"].alias("stop"),
            F.lit(order).alias("ord"),
            F.lit(rule.kind).alias("kind"),
        ),
    )
    nothing = F.array().cast("array<struct<start:bigint,stop:bigint,ord:int,kind:string>>")
    return F.when(text.rlike(rule.pattern), found).otherwise(nothing)


def findings(text: Column, rules: Sequence[Rule]) -> Column:
    """All spans of a text, by start, then rule order."""
    return F.array_sort(F.concat(*[spans(text, rule, i) for i, rule in enumerate(rules)]))


def blob_of(text: Column) -> Column:
    """Content address; a null text is the empty text."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan_unseen(
    docs: DataFrame, rules: Sequence[Rule] = RULES, ledger: DataFrame | None = None
) -> DataFrame:
    """New ledger rows (blob, rules_version, findings): blobs of `docs` the ledger lacks.

    Blobs without findings get a row too, with an empty array, so that they count as seen. A
    null text is the empty one. Repeated texts, and equal texts under any ids, give one row; an
    empty table none. Other columns than `text` are not read.
    """
    version = rules_version(rules)
    text = F.coalesce(F.col("text"), F.lit(""))
    blobs = docs.select(blob_of(F.col("text")).alias("blob"), text.alias("text"))
    if ledger is not None:
        seen = ledger.where(F.col("rules_version") == version).select("blob").distinct()
        blobs = blobs.join(seen, "blob", "left_anti")
    unseen = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    return unseen.select(
        "blob",
        F.lit(version).alias("rules_version"),
        findings(F.col("text"), rules).alias("findings"),
    )


def scan_documents(
    docs: DataFrame,
    rules: Sequence[Rule] = RULES,
    ledger: DataFrame | None = None,
    name: str = "findings",
) -> tuple[DataFrame, DataFrame]:
    """(docs with their findings in a column `name`, the ledger with this run's rows).

    Each row of `docs` is a path or version of its text; a null text is an empty one and has
    no findings. All rows and columns are kept, one called `name` is replaced. The
    returned ledger is stored; append it, or pass it on as it is to the next run.
    """
    fresh = stored_once(scan_unseen(docs, rules, ledger), "secret-ledger")
    version = rules_version(rules)
    known = fresh if ledger is None else ledger.unionByName(fresh)
    blob, hit_blob, hit = unused(docs, "_blob", "_hit_blob", "_hit")
    hits = known.where(
        (F.col("rules_version") == version) & (F.size("findings") > 0)
    ).select(F.col("blob").alias(hit_blob), F.col("findings").alias(hit))
    nothing = F.array().cast("array<struct<start:bigint,stop:bigint,ord:int,kind:string>>")
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    back = (
        docs.withColumn(blob, blob_of(F.col("text")))
        .join(hits, F.col(blob) == F.col(hit_blob), "left")
        .select(*kept, F.coalesce(hit, nothing).alias(name))
    )
    return back, known


def redacted(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by `mark`; spans that overlap count as one."""
    start = F.struct(F.lit(0).cast("bigint").alias("pos"), F.lit("").alias("out"))

    def cut(state: Column, f: Column) -> Column:
        gap = F.substring(text, (state["pos"] + 1).cast("int"), (f["start"] - state["pos"]).cast("int"))
        fresh = F.struct(
            f["stop"].alias("pos"), F.concat(state["out"], gap, F.lit(mark)).alias("out")
        )
        longer = F.struct(
            F.greatest(state["pos"], f["stop"]).alias("pos"), state["out"].alias("out")
        )
        return F.when(f["start"] >= state["pos"], fresh).otherwise(longer)

    whole = F.aggregate(
        found,
        start,
        cut,
        lambda s: F.concat(
            s["out"], F.substring(text, (s["pos"] + 1).cast("int"), F.length(text))
        ),
    )
    return F.when(F.size(found) > 0, whole).otherwise(text)


def redact_documents(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """`docs` with secrets replaced in `text`, same rows and columns; `n_chars` counted anew.

    Null texts stay null, texts without secrets as they are, repeated rows are each redacted.
    Columns of any name pass through. An empty table gives no rows.
    """
    (found,) = unused(docs, "findings")
    scanned, _ = scan_documents(docs, rules, name=found)
    out = scanned.withColumn("text", redacted(F.col("text"), F.col(found)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = F.size(found) > 0
        out = out.withColumn(
            "n_chars",
            F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")),
        )
    return out.select(*docs.columns)


def digests(scanned: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, one count per base kind, digest of the base spans, and all spans as text.

    One row per row of `scan_documents`; a null or empty text has counts of 0, the digest of
    the empty string and no spans. Spans that start together go by the order of the rules.
    """

    def joined(found: Column) -> Column:
        return F.array_join(
            F.transform(
                found, lambda f: F.concat_ws(":", f["kind"], f["start"], f["stop"])
            ),
            ",",
        )

    base = [i for i, rule in enumerate(rules) if rule.base]
    only_base = F.filter("findings", lambda f: f["ord"].isin(base))

    def count(order: int) -> Column:
        return F.size(F.filter("findings", lambda f: f["ord"] == F.lit(order))).cast("bigint")

    counts = [count(i).alias(f"n_{rules[i].kind}") for i in base]
    return scanned.select(
        "doc_id",
        *counts,
        F.sha2(joined(only_base), 256).alias("base_sha256"),
        joined(F.col("findings")).alias("spans"),
    )
