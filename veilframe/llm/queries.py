"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import (
    chat,
    decontamination,
    html_text,
    mixing,
    neardup,
    packing,
    quality,
    resampling,
    secrets,
    topk,
    toxicity,
    vectors,
    whitening,
)
from veilframe.llm.common import held_out, table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = held_out("doc_id", 3, 1)
    scored = toxicity.score_toxicity(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), allowed=~fold
    )
    return scored.select("doc_id", fold.alias("held_out"), "score", "predicted")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
    )


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # Conversation -7, whose texts spell the template's own marks.
    marks = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return chat.read_back(chat.format_turns(given.unionByName(marks)))


def op5_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op7_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned, _ = secrets.scan_documents(docs)
    return secrets.digests(scanned)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = held_out("doc_id", 5, 0)
    ensemble = quality.learn(docs, table(spark, sf_dir, "labels"), allowed=~fold)
    return quality.score_documents(docs, ensemble).select(
        "doc_id", fold.alias("held_out"), "score", "predicted"
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, pieces = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return mixing.taken_words(placed, pieces)


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digests(
        decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    )


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    whitened = whitening.whiten(table(spark, sf_dir, "embeddings"))
    # The operator's deviation has 38 digits; one that no long holds is null here.
    return whitened.withColumn("deviation", F.col("deviation").try_cast("bigint"))


def _words_sql(relation: str, ident: str) -> str:
    """row, the id and the list w of lower-case words of each row's text."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return (
        f"SELECT row_number() OVER () AS r, {ident}, "
        rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {relation}"
    )


def _decontamination_sql() -> str:
    size = decontamination.SIZE
    return f"""
        WITH docs AS ({_words_sql("documents", "doc_id")}),
        items AS ({_words_sql("benchmark", "item_id")}),
        grams AS (
            SELECT DISTINCT item_id, least({size}, len(w)) AS l,
                array_to_string(w[i:i + least({size}, len(w)) - 1], ' ') AS g
            FROM (SELECT *, unnest(range(1, greatest(len(w) - {size - 1}, 1) + 1)) AS i
                  FROM items WHERE len(w) > 0)
        ),
        windows AS (
            SELECT r, i, l, array_to_string(w[i:i + l - 1], ' ') AS g FROM (
                SELECT *, unnest(range(1, len(w) - l + 2)) AS i
                FROM docs CROSS JOIN (SELECT DISTINCT l FROM grams) WHERE len(w) >= l)
        ),
        hits AS (SELECT r, i, windows.l, item_id FROM windows JOIN grams USING (l, g)),
        covered AS (
            SELECT r, count(DISTINCT p) AS n_hit
            FROM (SELECT r, unnest(range(i, i + l)) AS p FROM (SELECT DISTINCT r, i, l FROM hits))
            GROUP BY r
        ),
        found AS (
            SELECT r, count(DISTINCT item_id) AS n_items,
                string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
            FROM hits GROUP BY r
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
            coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
    """


def _resampling_sql() -> str:
    buckets = resampling.BUCKETS
    # crc32 bit by bit over the bytes of each distinct word.
    bits = "list_reduce(range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b))"
    crc = f"xor(list_reduce(bytes, lambda c, b: {bits}, 4294967295), 4294967295)"
    digit = "(instr('0123456789ABCDEF', substr(h, {0}, 1)) - 1)"
    pairs = f"16 * {digit.format('2 * i + 1')} + {digit.format('2 * i + 2')}"
    return f"""
        WITH docs AS ({_words_sql("documents", "doc_id")}),
        items AS ({_words_sql("benchmark", "item_id")}),
        own AS (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(w) AS word FROM docs) GROUP BY ALL),
        aim AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM items) GROUP BY word),
        spelt AS (
            SELECT word, hex(encode(word)) AS h
            FROM (SELECT word FROM own UNION SELECT word FROM aim)
        ),
        coded AS (
            SELECT word, list_transform(range(len(h) // 2), lambda i: CAST({pairs} AS BIGINT)) AS bytes
            FROM spelt
        ),
        places AS (SELECT word, {crc} % {buckets} AS bucket FROM coded),
        raw AS (SELECT bucket, sum(n) AS n FROM own JOIN places USING (word) GROUP BY bucket),
        target AS (SELECT bucket, sum(n) AS n FROM aim JOIN places USING (word) GROUP BY bucket),
        sums AS (SELECT (SELECT coalesce(sum(n), 0) FROM raw) + {buckets} AS s,
                        (SELECT coalesce(sum(n), 0) FROM target) + {buckets} AS t),
        gains AS (
            SELECT bucket, CAST(floor(1000 * ln(
                (CAST(coalesce(target.n, 0) + 1 AS DOUBLE) * s) / (CAST(raw.n + 1 AS DOUBLE) * t)
            )) AS BIGINT) AS gain
            FROM raw LEFT JOIN target USING (bucket) CROSS JOIN sums
        ),
        weights AS (
            SELECT r, CAST(sum(own.n) AS BIGINT) AS n_features, CAST(sum(own.n * gain) AS BIGINT) AS weight
            FROM own JOIN places USING (word) JOIN gains USING (bucket) GROUP BY r
        ),
        noise AS (
            SELECT r, list_reduce(list_transform(
                range(1, 9),
                lambda i: CAST(instr('0123456789abcdef', substr(sha256('{resampling.SEED}:' || doc_id), i, 1)) - 1 AS BIGINT)
            ), lambda a, b: a * 16 + b) AS h FROM docs
        ),
        scored AS (
            SELECT r, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
            FROM docs JOIN noise USING (r) LEFT JOIN weights USING (r)
        ),
        ranked AS (
            SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n
            FROM scored WHERE n_features >= {resampling.LEAST_WORDS}
        )
        SELECT doc_id, n_features, weight, score,
            CASE WHEN rank <= {resampling.PERCENT} * n // 100 THEN rank END AS rank
        FROM scored LEFT JOIN ranked USING (r)
    """


def _secrets_sql() -> str:
    """All spans of every rule: matches and the texts between them, in running lengths."""

    def literal(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    found = " UNION ALL ".join(
        f"SELECT doc_id, '{r.kind}' AS kind, {i} AS ord, {r.least} AS least, "
        f"regexp_extract_all(x, {literal(r.pattern)}, 0) AS w, "
        f"regexp_extract_all(x, {literal(r.pattern)}, {r.group}) AS g, "
        f"string_split_regex(x, {literal(r.pattern)}) AS s FROM texts"
        for i, r in enumerate(secrets.RULES)
    )
    base = [i for i, r in enumerate(secrets.RULES) if r.base]
    counts = ", ".join(
        f"count(*) FILTER (ord = {i}) AS n_{secrets.RULES[i].kind}" for i in base
    )
    joined = "string_agg(kind || ':' || start || ':' || (start + width), ',' ORDER BY start, ord)"
    return f"""
        WITH texts AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
        found AS ({found}),
        numbered AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM found WHERE len(w) > 0),
        spans AS (
            SELECT doc_id, kind, ord, length(w[i]) AS width, CAST(
                list_sum(list_transform(s[1:i], lambda y: length(y)))
                + coalesce(list_sum(list_transform(w[1:i - 1], lambda y: length(y))), 0)
                AS BIGINT) AS start
            FROM numbered WHERE length(g[i]) >= least
        )
        SELECT texts.doc_id, {counts},
            sha256(coalesce({joined} FILTER (ord <= {max(base)}), '')) AS base_sha256,
            coalesce({joined} FILTER (ord IS NOT NULL), '') AS spans
        FROM texts LEFT JOIN spans ON texts.doc_id = spans.doc_id GROUP BY texts.doc_id
    """


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_toxicity": op2_toxicity,
    "op3_packing": op3_packing,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_embedding_neardup": op5_embedding_neardup,
    "op6_topk_search": op6_topk_search,
    "op7_minhash_neardup": op7_minhash_neardup,
    "op8_secret_scans": op8_secret_scans,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_mixing": op10_mixing,
    "op11_decontamination": op11_decontamination,
    "op12_resampling": op12_resampling,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op4_chat_formatting": r"""
        WITH turns AS (
            SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES
                (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
        ), escaped AS (
            SELECT *, regexp_replace(
                text,
                '([<\[])(\\*)(<SYS>>|</SYS>>|INST\]|/INST\]|s>|/s>|<ROLE>>|</ROLE>>|<TEXT>>|<NULL>>)',
                '\1\\\2\3', 'g'
            ) AS safe
            FROM turns
        )
        SELECT
            conv_id,
            count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
            CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
            sha256(coalesce(
                string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), ''
            )) AS loss_sha256,
            CAST(sum(length(safe) + CASE role WHEN 'assistant' THEN 7 WHEN 'user' THEN 13 ELSE 15 END)
                AS BIGINT) AS formatted_chars
        FROM escaped GROUP BY conv_id
    """,
    "op5_embedding_neardup": r"""
        WITH RECURSIVE usable AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
            ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
            WHERE list_cosine_similarity(a.v, b.v) >= 0.9
        ), reached AS (
            SELECT vec_id, vec_id AS low FROM embeddings
            UNION
            SELECT links.b, reached.low FROM reached JOIN links ON reached.vec_id = links.a
        ), lowest AS (SELECT vec_id, min(low) AS component_id FROM reached GROUP BY vec_id),
        counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
        FROM embeddings e JOIN lowest USING (vec_id) LEFT JOIN counts ON counts.a = e.vec_id
    """,
    "op6_topk_search": r"""
        WITH whole AS (
            SELECT vec_id,
                list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
        ), ranked AS (
            SELECT query_id, vec_id, score, CAST(row_number() OVER (
                PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
            FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
    "op8_secret_scans": _secrets_sql(),
    "op11_decontamination": _decontamination_sql(),
    "op12_resampling": _resampling_sql(),
}
