"""The corpus operators as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import deduplicate

    out = deduplicate(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    out = near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import scratch
    from .token_files import BLOCK_SCHEMA, read_documents, write_blocks

    path = scratch(spark, "token-files")
    write_blocks(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return read_documents(spark.read.schema(BLOCK_SCHEMA).parquet(path))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import round_trip

    return round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge

    return judge(_table(spark, sf_dir, "pages"))


#: Production passes its own secret; this one makes the query's result reproducible.
PII_KEY = b"key of the registered query only"


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pseudonyms

    return pseudonyms(_table(spark, sf_dir, "documents"), PII_KEY)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import decide, ledger

    return decide(ledger(_table(spark, sf_dir, "documents")))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import main_text

    return main_text(_table(spark, sf_dir, "pages"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import fit, predict

    docs = _table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(_table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit

    return audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_simhash": op2_simhash,
    "op3_token_files": op3_token_files,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_url_filters": op5_url_filters,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_pii": op7_pii,
    "op8_quality_rules": op8_quality_rules,
    "op9_html_extraction": op9_html_extraction,
    "op10_language_id": op10_language_id,
    "op11_warc": op11_warc,
    "op12_collocations": op12_collocations,
    "op13_filter_audit": op13_filter_audit,
}

def _quality_sql() -> str:
    from .quality import MEASURES, RULES, mask_of

    space = r"[^\x20\x09-\x0D]"
    failures = " + ".join(f"CASE WHEN {r.fails} THEN {1 << i} ELSE 0 END" for i, r in enumerate(RULES))
    window = " || ' ' || ".join(["w", *[f"lead(w, {j}) OVER o" for j in range(1, 8)]])
    failed = lambda policy: f"(failures & {mask_of(policy, 1)}) <> 0"
    return rf"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{space}+') AS ws,
                list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{space}')) AS ls FROM documents
        ), words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d
        ), win AS (
            SELECT doc_id, i, {window} AS g FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)
        ), again AS (
            SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win WHERE g IS NOT NULL) WHERE c > 1
        ), covered AS (
            SELECT doc_id, sum(gap) AS n FROM (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS gap FROM again) GROUP BY doc_id
        ), measured AS (
            SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
                length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
                coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(list_filter(generate_series(2, len(ws)), lambda i: ws[i] = ws[i - 1]))::BIGINT AS n_stutters,
                len(ls)::BIGINT AS n_lines, length(regexp_replace(t, '[^\p{{L}}]+', '', 'g'))::BIGINT AS n_letters, length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g'))::BIGINT AS n_capitals
            FROM d LEFT JOIN covered c ON d.doc_id = c.doc_id
        ), book AS (SELECT *, ({failures})::BIGINT AS failures FROM measured)
        SELECT doc_id, {", ".join(MEASURES)}, failures, {failed("base")} AS base_failed, NOT ({failed("base")} OR {failed("corpus")}) AS kept FROM book
    """


def _collocation_sql() -> str:
    return rf"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
        ), ws AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
        ), totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM ws GROUP BY lang
        ), grams AS (
            SELECT lang, d, unnest(list_transform(generate_series(1, len(w) - d + 1), lambda i: array_to_string(w[i:i + d - 1], ' '))) AS phrase
            FROM ws, (SELECT unnest([1, 2, 3, 4, 5]) AS d) WHERE len(w) >= d
        ), f AS (SELECT lang, d, phrase, count(*) AS c FROM grams GROUP BY ALL HAVING c >= 100
        ), longer AS (
            SELECT s.lang, s.phrase FROM f s JOIN f g ON s.lang = g.lang AND g.d > s.d AND s.d > 1 AND contains(' ' || g.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * g.c >= 100 * s.c
        ), cuts AS (
            SELECT lang, phrase, c AS a, unnest(generate_series(1, d - 1)) AS k FROM f WHERE d > 1 AND NOT EXISTS (SELECT 1 FROM longer o WHERE o.lang = f.lang AND o.phrase = f.phrase)
        ), parts AS (
            SELECT *, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS first_, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rest FROM cuts
        ), scored AS (
            SELECT p.lang, p.phrase, p.a, p.k, x.c AS l, y.c AS r, t.n, ((1000::HUGEINT * p.a * t.n) // (x.c::HUGEINT * y.c))::BIGINT AS score
            FROM parts p JOIN f x ON x.lang = p.lang AND x.phrase = p.first_ JOIN f y ON y.lang = p.lang AND y.phrase = p.rest JOIN totals t ON t.lang = p.lang
        ), lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM lowest QUALIFY rank <= 2000
    """


def _audit_sql() -> str:
    """Every order is gone through document by document, without cells."""
    word = r"[^\x20\x09-\x0D]+"
    fails = "CASE f WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END"
    return rf"""
        WITH t AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS ws FROM documents
        ), marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id
        ), rows_ AS (
            SELECT part, len(ws) < 50 AS a, 100 * len(list_distinct(ws)) < 65 * len(ws) AS b,
                100 * (length(text) - length(regexp_replace(text, '[A-Z]+', '', 'g'))) > 5 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
                coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
            FROM t LEFT JOIN marks ON t.doc_id = marks.doc_id
        ), f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
        ), orders AS (
            SELECT p.f || q.f || r.f || s.f || u.f AS filter_order FROM f p, f q, f r, f s, f u
            WHERE len(list_distinct([p.f, q.f, r.f, s.f, u.f])) = 5
        ), steps AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders
        ), letters AS (SELECT filter_order, step, filter_order[step] AS f, filter_order[1:step - 1] AS prior FROM steps
        ), judged AS (
            SELECT part, filter_order, step, f, good, toxic, {fails} AS fails,
                (a AND contains(prior, 'A') OR b AND contains(prior, 'B') OR c AND contains(prior, 'C') OR d AND contains(prior, 'D') OR e AND contains(prior, 'E')) AS gone,
                a::INT + b::INT + c::INT + d::INT + e::INT AS failures
            FROM rows_, letters
        ), counted AS (
            SELECT part, filter_order, step, f, count(*) FILTER (NOT fails AND NOT gone) AS kept, count(*) FILTER (fails AND NOT gone) AS removed, count(*) FILTER (fails AND gone) AS redundant,
                count(*) FILTER (fails AND failures = 1) AS unique_fails, count(*) FILTER (fails AND NOT gone AND good) AS good_lost, count(*) FILTER (fails AND NOT gone AND toxic) AS toxic_lost
            FROM judged GROUP BY ALL
        )
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM counted
    """


ORACLE_SQL: dict[str, str] = {
    "op6_exact_dedup": f"""
        WITH norm AS (
            SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents
        ), best AS (
            SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM norm GROUP BY t
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm.t) AS text_sha256
        FROM norm JOIN best ON norm.t = best.t
    """,
    "op8_quality_rules": _quality_sql(),
    "op11_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS response FROM p
        ), told AS (SELECT *, payload_bytes >= 100 AND page_id <> response AS again FROM firsts)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN response END AS refers_to FROM told
    """,
    "op12_collocations": _collocation_sql(),
    "op13_filter_audit": _audit_sql(),
}
