"""The registered queries of these operators, and equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import backoff, decontaminate, extraction, jaccard, merkle, negatives, pieces, quality, secrets, shards, suffixes, tokencount, toxicity
from logloom.llm.common import held_out, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where one exists, the SQL that gives the same rows."""

    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


STOPS = ", ".join(f"'{word}'" for word in quality.STOP_WORDS)


@query(
    "op1_quality_rules",
    rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
    f AS (SELECT doc_id, len(ws) AS n_words, coalesce(length(array_to_string(ws, '')), 0) AS word_chars,
                 length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
                 len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
                 len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*\x{{2022}}]'))) AS n_bullet,
                 len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|\x{{2026}})[\x20\x09-\x0D]*$'))) AS n_dots,
                 len(list_filter(ws, lambda x: lower(x) IN ({STOPS}))) AS n_stop FROM w),
    g AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS k
          FROM w, unnest(range(1, len(ws) - 6)) AS u(i) WHERE len(ws) >= 8),
    r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM
          (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) AS c, unnest(range(0, 8)) AS u(j)
          WHERE c > 1 GROUP BY doc_id),
    a AS (SELECT f.*, coalesce(r.n, 0) AS n_repeat_words FROM f LEFT JOIN r USING (doc_id)),
    b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND NOT coalesce(word_chars / n_words < 2 OR word_chars / n_words > 20
             OR n_symbols / n_words > 0.1 OR n_stop / n_words < 0.03, false)
             AND NOT coalesce(n_dup_lines / n_lines > 0.3 OR n_bullet / n_lines > 0.9 OR n_dots / n_lines > 0.3, false) AS kept
    FROM b
    """,
)
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and the rules' verdict of every document."""
    return quality.apply_rules(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from labels outside the held-out fifth."""
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score_texts(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


SHARDS, OLD_SHARDS = 24, 16


@query("op3_resharding")
def op3_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents from shards by source into 24 shards of near equal bytes, moving the fewest bytes."""
    docs = read_table(spark, sf_dir, "documents")
    rows = shards.document_rows(docs, shards.hash_shard(F.col("source"), OLD_SHARDS))
    placed = shards.place_rows(rows, SHARDS, ["doc_id", "text_crc32", "size"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard"
    )


@query(
    "op4_decontamination",
    r"""
    WITH items AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(
                     translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
    docs AS (SELECT doc_id, regexp_extract_all(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
    wins AS (SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(list_slice(ws, i, i + least(13, len(ws)) - 1), ' ') AS k
             FROM items, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS u(i) WHERE len(ws) > 0),
    dwins AS (SELECT doc_id, i, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS k
              FROM docs, (SELECT DISTINCT n FROM wins) AS s, unnest(range(1, len(ws) - n + 2)) AS u(i) WHERE len(ws) >= n),
    hits AS (SELECT doc_id, i, n, item_id FROM dwins JOIN wins USING (n, k)),
    words AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hits, unnest(range(0, n)) AS u(j) GROUP BY doc_id),
    found AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256
              FROM (SELECT DISTINCT doc_id, item_id FROM hits) AS d GROUP BY doc_id)
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           coalesce(items_sha256, sha256('')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
    FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
    """,
)
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    found = decontaminate.find_overlaps(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return decontaminate.judge(found)


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-pair tokens of every document."""
    return tokencount.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op7_secrets")
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.find_secrets(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_pair"
    )


@query("op9_sentencepiece")
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and a digest of the text that they decode to."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.round_trip(read_table(spark, sf_dir, "documents"), path)


@query(
    "op6_jaccard_join",
    r"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x20\x09-\x0D]+') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + least(4, len(ws)) - 1), ' ') AS k
          FROM d, unnest(range(1, len(ws) - least(4, len(ws)) + 2)) AS u(i) WHERE len(ws) > 0),
    c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s AS x JOIN s AS y USING (k) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM p JOIN c AS ca ON ca.doc_id = a JOIN c AS cb ON cb.doc_id = b WHERE 100 * m >= 85 * (ca.n + cb.n - m)),
    r AS (SELECT doc_id AS a, doc_id AS z FROM d UNION SELECT l.b, r.z FROM r JOIN l ON l.a = r.a)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
    FROM d LEFT JOIN c USING (doc_id) JOIN (SELECT a AS doc_id, min(z) AS component_id FROM r GROUP BY a) AS m USING (doc_id)
    """,
)
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose 4-word shingles are similar."""
    return jaccard.similar_groups(read_table(spark, sf_dir, "documents"))


@query(
    "op8_suffix_repeats",
    r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x20\x09-\x0D]+') AS ws FROM documents),
    g AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i + 1, i + 50), ' ')) AS k
          FROM d, unnest(range(0, len(ws) - 49)) AS u(i) WHERE len(ws) >= 50),
    c AS (SELECT k FROM g GROUP BY k HAVING min(doc_id) <> max(doc_id)),
    s AS (SELECT doc_id, i, i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 AS gap FROM g SEMI JOIN c USING (k)),
    n AS (SELECT doc_id, i, sum(coalesce(gap, false)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM s),
    p AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM n GROUP BY doc_id, span)
    SELECT doc_id, any_value(len(ws))::BIGINT AS n_words, count(*) AS n_spans, sum(z - a)::BIGINT AS n_repeated,
           string_agg(a::VARCHAR || ':' || z::VARCHAR, ',' ORDER BY a) AS spans
    FROM p JOIN d USING (doc_id) GROUP BY doc_id
    """,
)
def op8_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a passage of 50 words or more that another document also has."""
    found = suffixes.repeated_passages(read_table(spark, sf_dir, "documents"))
    return found.withColumn("spans", F.array_join("spans", ","))


@query(
    "op10_backoff_scores",
    r"""
    WITH d AS (SELECT doc_id, doc_id % 2 AS f, regexp_extract_all(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x20\x09-\x0D]+') AS ws FROM documents),
    t AS (SELECT doc_id, f, i, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS v FROM d, unnest(range(1, len(ws) + 1)) AS u(i)),
    n AS (SELECT 1 - f AS f, count(*) AS n FROM t GROUP BY 1),
    c1 AS (SELECT 1 - f AS f, w, count(*) AS c FROM t GROUP BY ALL),
    c2 AS (SELECT 1 - f AS f, v, w, count(*) AS c FROM t WHERE v IS NOT NULL GROUP BY ALL),
    s AS (SELECT t.doc_id, c2.c IS NOT NULL AS hit, CASE WHEN c2.c IS NOT NULL THEN ln(c2.c / cv.c)
                 ELSE ln(coalesce(c1.c, 0.5) / n.n) + CASE WHEN t.v IS NULL THEN 0 ELSE ln(0.4) END END AS l
          FROM t JOIN n ON n.f = t.f LEFT JOIN c2 ON c2.f = t.f AND c2.v = t.v AND c2.w = t.w
          LEFT JOIN c1 ON c1.f = t.f AND c1.w = t.w LEFT JOIN c1 AS cv ON cv.f = t.f AND cv.w = t.v)
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(b, 0)::BIGINT AS n_backoff,
           round(coalesce(l, 0) / greatest(len(ws), 1), 6) AS mean_log_score
    FROM d LEFT JOIN (SELECT doc_id, count(*) FILTER (NOT hit) AS b, sum(l) AS l FROM s GROUP BY doc_id) AS x USING (doc_id)
    """,
)
def op10_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff score of every document from the counts of the other half of the documents."""
    scored = backoff.score_documents(read_table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "n_backoff", F.round(F.coalesce("mean_log_score", F.lit(0.0)), 6).alias("mean_log_score"))


@query("op10_leave_one_out")
def op10_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff score of every document up to trigrams, from the counts of all other documents."""
    scored = backoff.score_documents(read_table(spark, sf_dir, "documents"), order=3, leave_one_out=True)
    return scored.select("doc_id", "n_words", "n_backoff", F.round(F.coalesce("mean_log_score", F.lit(0.0)), 6).alias("mean_log_score"))


def merkle_sql(levels: int = 10, top_levels: int = 4) -> str:
    """The manifest in SQL: two queries per level, enough for 8 ** levels rows of a language."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    crc = (
        "xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform("
        "string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)), lambda c, b: list_reduce(list_prepend("
        "xor(c, b), list_transform(range(8), lambda z: 0::UBIGINT)), lambda s, z: xor(s >> 1, (s & 1) * 3988292384::UBIGINT))))"
    )
    head = "concat(" + ", ".join(
        f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars")
    ) + ", "
    body = "coalesce(strlen({0})::VARCHAR || ':' || {0}, '-'))"
    parts = [
        f"t AS (SELECT *, CASE WHEN {crc} % 3 = 0 THEN translate(text, '{upper}', '{lower}') ELSE text END AS found FROM documents)",
        f"l AS (SELECT doc_id, coalesce('=' || lang, '') AS g, sha256({head}{body.format('text')}) AS h, "
        f"sha256({head}{body.format('found')}) AS f FROM t)",
        "r0 AS (SELECT doc_id, g, h AS leaf, f, '' AS proof, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM l)",
        "n0 AS (SELECT g, pos, leaf AS h FROM r0)",
    ]

    def level(k: int, rows: str, nodes: str) -> list[str]:
        before = "string_agg(h, '') OVER (PARTITION BY g, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        after = "string_agg(h, '') OVER (PARTITION BY g, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
        return [
            f"s{k} AS (SELECT g, pos, h, count(*) OVER (PARTITION BY g) AS n, coalesce({before}, '') AS a, coalesce({after}, '') AS z FROM {nodes})",
            f"n{k + 1} AS (SELECT g, pos // 8 AS pos, CASE WHEN any_value(n) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h "
            f"FROM s{k} GROUP BY g, pos // 8)",
            f"r{k + 1} AS (SELECT r.* REPLACE (r.pos // 8 AS pos, CASE WHEN n = 1 THEN f ELSE sha256(a || f || z) END AS f, "
            f"CASE WHEN n = 1 THEN proof ELSE proof || a || z END AS proof) FROM {rows} AS r JOIN s{k} AS s USING (g, pos))",
        ]

    for k in range(levels):
        parts += level(k, f"r{k}", f"n{k}")
    parts += [
        f"u AS (SELECT g AS name, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS place FROM n{levels})",
        f"r{levels}x AS (SELECT r.* REPLACE ('' AS g, u.place AS pos), subroot FROM r{levels} AS r JOIN u ON u.name = r.g)",
        f"n{levels}x AS (SELECT '' AS g, place AS pos, subroot AS h FROM u)",
    ]
    for k in range(levels, levels + top_levels):
        x = "x" if k == levels else ""
        parts += level(k, f"r{k}{x}", f"n{k}{x}")
    end = levels + top_levels
    # Many rows refer to the same nodes: without MATERIALIZED each level would be computed again for every later one.
    with_ = ",\n".join(part.replace(" AS (", " AS MATERIALIZED (", 1) for part in parts)
    return (
        f"WITH {with_}\nSELECT doc_id, leaf, subroot, n.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = n.h AS verified "
        f"FROM r{end} AS r JOIN n{end} AS n ON true"
    )


@query("op13_merkle_manifest", merkle_sql())
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether the text as found still leads to the root."""
    return merkle.manifest(read_table(spark, sf_dir, "documents"), changed=merkle.tampered())


@query(
    "op12_hard_negatives",
    """
    WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
               FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
               AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
          FROM e AS a JOIN e AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
    n AS (SELECT p.a AS anchor_id, p.b AS positive_id, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score,
                 row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b)::INT AS rank
          FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
    SELECT * FROM n WHERE rank <= 10
    """,
)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, after the labels of every seventh have moved on by one."""
    rows = read_table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


@query("op11_html_extraction")
def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = read_table(spark, sf_dir, "pages")
    return extraction.extract(pages.select("page_id", "url", "html"), keep=["url"])
