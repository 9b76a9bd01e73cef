"""Queries of the training-data operators and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from barwright.llm import chat, decontam, exact, langid, licenses, mixing, neardup, pii, secrets, tokens
from barwright.llm.common import cut, table

#: Key of the surrogates; a secret of whoever runs the scan. This one serves these queries only.
PII_KEY = b"barwright-query-key"
#: Where the vocabulary files of public tokenizers are; a parameter, never copied.
TOKENIZER = "word_bpe_49k.json"


def op1_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents name no repository: (source, lang) stands for it, and source for its owner."""
    return secrets.scan_secrets(table(spark, sf_dir, "documents"), owner="source", repo="concat_ws('/', source, lang)")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), block_rows=64, power=0.5)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, num=85, den=100)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise_rows(docs, PII_KEY)


def op6_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op7_transcript_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw transcripts written from conversations, parsed and rendered; true_roles are the roles
    that the table names."""
    raw = cut(chat.transcripts(table(spark, sf_dir, "conversations")), "chat-raw")
    out = chat.parse_transcripts(raw, chat.fit(raw))
    true = F.filter("states", lambda s: s % 2 == 0)
    names = F.array(*[F.lit(r) for r in chat.ROLES])
    return out.select("conv_id", "part", F.size("turns").alias("n_turns"), F.concat_ws(",", F.transform(true, lambda s: F.element_at(names, (s / 2).cast("int") + 1))).alias("true_roles"),
                      F.concat_ws(",", F.transform("turns", lambda t: t["role"])).alias("roles"), "chat")


def op8_benchmark_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), limit=2048)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = exact.DigestIndex(spark, rows=docs.count())
    try:
        return exact.annotate(docs, index)
    finally:
        index.drop()  # the result reads the written verdicts only


QUERIES = {f.__name__: f for f in (op1_secret_ownership, op2_mix_sources, op3_license_scan, op4_near_duplicates, op5_pii_surrogates, op6_language_crf, op7_transcript_hmm, op8_benchmark_tiling, op9_token_counts, op10_exact_dedup)}
QUERIES["pipeline"] = corpus_pipeline.run

_CASES = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_QUOTE = "[\"'']?"
#: Patterns of secrets by kind, and which group is the value.
_SECRETS = [(f"({_CASES}){_QUOTE} *[:=] *{_QUOTE}([A-Za-z0-9+/_.=-]+)", 2), ("AKIA[A-Z0-9]+", 0), ("[0-9a-f]+", 0), ("[A-Za-z0-9+/_-]{20,}={0,2}", 0)]
_FOUND = " UNION ALL ".join(f"SELECT rid, owner, repo, {k} AS kind, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {g}) AS vs, string_split_regex(t, '{p}') AS ps FROM d" for k, (p, g) in enumerate(_SECRETS))

ORACLES = {
    # where a match lies follows from what lies between matches
    "op1_secret_ownership": f"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repo FROM documents),
        x AS ({_FOUND}), y AS (SELECT *, unnest(range(1, len(ms) + 1)) AS j FROM x WHERE len(ms) > 0),
        z AS (SELECT rid, owner, repo, kind, vs[j] AS v, length(ms[j]) AS n, list_sum(list_transform(ps[1:j], lambda p: length(p)))::BIGINT + coalesce(list_sum(list_transform(ms[1:j - 1], lambda m: length(m))), 0)::BIGINT AS s FROM y),
        b AS (SELECT *, s + n AS e FROM z WHERE CASE kind WHEN 0 THEN length(v) >= 6 WHEN 1 THEN n >= 20 WHEN 2 THEN n >= 24 ELSE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') END),
        f AS (SELECT * FROM b WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM b o WHERE o.kind < 3 AND o.rid = b.rid AND o.s < b.e AND b.s < o.e)),
        w AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repo)) AS repos FROM f GROUP BY 1),
        g AS (SELECT rid, kind, s, e, owners, repos, owners >= {secrets.EXAMPLE_OWNERS} OR owners > 1 AND repos >= {secrets.EXAMPLE_REPOS} AS copied, round(list_aggregate(string_split(v, ''), 'entropy'), 9) >= {secrets.LIVE_BITS} AS random,
          ['assign', 'access', 'hex', 'opaque'][kind + 1] || ':' || s || ':' || e AS name FROM f JOIN w USING (v)),
        r AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg(name, ',' ORDER BY s, kind, e) FILTER (kind < 3) AS base,
          string_agg(name, ',' ORDER BY s, kind, e) FILTER (kind < 3 OR random AND NOT copied) AS spans, count(*) FILTER (random AND NOT copied) AS n_live, count(*) FILTER (copied) AS n_example, max(owners) AS n_owners, max(repos) AS n_repos FROM g GROUP BY 1)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
          coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(n_owners, 0) AS n_owners, coalesce(n_repos, 0) AS n_repos FROM d LEFT JOIN r USING (rid)
    """,
    # every pair of different sets that share a shingle, and all that can be reached over links
    "op4_near_duplicates": """
        WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (SELECT rid, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')))) END AS sh FROM w),
        c AS (SELECT sh, row_number() OVER () AS cls, min(doc_id) AS low FROM s WHERE len(sh) > 0 GROUP BY sh), e AS (SELECT cls, len(sh) AS n, unnest(sh) AS g FROM c),
        p AS (SELECT a.cls AS x, b.cls AS y FROM e a JOIN e b ON a.g = b.g AND a.cls < b.cls GROUP BY a.cls, b.cls, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        l AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p), r AS (SELECT cls AS x, cls AS y FROM c UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
        m AS (SELECT r.x AS cls, min(low) AS component_id FROM r JOIN c ON c.cls = r.y GROUP BY 1)
        SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(component_id, s.doc_id) AS component_id, s.doc_id = coalesce(component_id, s.doc_id) AS kept FROM s LEFT JOIN c ON c.sh = s.sh LEFT JOIN m ON m.cls = c.cls
    """,
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
}
