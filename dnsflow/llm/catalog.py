"""The queries of the subpackage and their DuckDB twins, by name."""

from __future__ import annotations

from dnsflow.llm import alignment, bpe, decontaminate, embeddings, hmm, language, pii, quality, simhash, spelling, substring, urls, warc

QUERIES = {
    "op1_substring_dedup": substring.op1_substring_dedup,
    "op2_warc": warc.op2_warc,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_quality_pu": quality.op4_quality_pu,
    "op5_simhash_covering": simhash.op5_simhash_covering,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_embedding_pstable": embeddings.op7_embedding_pstable,
    "op8_hmm_score": hmm.op8_hmm_score,
    "op9_language_id": language.op9_language_id,
    "op10_pii_surrogates": pii.op10_pii_surrogates,
    "op11_url_filter": urls.op11_url_filter,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_alignment": alignment.op13_alignment,
}

ORACLE = {
    "op11_url_filter": urls.twin(),
    "op1_substring_dedup": """
        WITH d AS (
            SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), h AS (
            SELECT doc_id, unnest(list_transform(range(1, len(w) - 11), lambda i: {'i': i, 'k': array_to_string(w[i:i + 12], ' ')}), recursive := true)
            FROM d
        ), f AS (
            SELECT k, min(doc_id) AS least FROM h GROUP BY k
        ), c AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM h JOIN f USING (k) WHERE least < doc_id
        ), r AS (
            SELECT doc_id, list(p) AS ps, count(*) AS n FROM c GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
            sha256(array_to_string(list_filter(w, lambda x, i: NOT coalesce(list_contains(ps, i), false)), ' ')) AS kept_sha256
        FROM d LEFT JOIN r USING (doc_id)
    """,
    "op2_warc": """
        WITH p AS (
            SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
        ), q AS (
            SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS last FROM p
        )
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id < last THEN last END AS refers_to
        FROM q
    """,
    "op6_decontamination": """
        WITH b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
            FROM benchmark
        ), bw AS (
            SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(1, len(w) - 9) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS k, least(len(w), 10) AS n
            FROM b WHERE len(w) > 0
        ), d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
            FROM documents
        ), s AS (
            SELECT DISTINCT n FROM bw
        ), h AS (
            SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: {'i': i, 'k': array_to_string(w[i:i + n - 1], ' ')}), recursive := true)
            FROM d, s
        ), f AS (
            SELECT doc_id, i, h.n, item_id FROM h JOIN bw ON h.k = bw.k AND h.n = bw.n
        ), c AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM f) GROUP BY doc_id
        ), l AS (
            SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM f) GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)
    """,
    "op7_embedding_pstable": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        ), usable AS (
            SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL
                AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
        ), p AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
            WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.98 END
        ), r AS (
            SELECT vec_id, vec_id AS root FROM v
            UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.vec_id WHERE r.root < p.b
        ), c AS (
            SELECT vec_id, min(root) AS component_id FROM r GROUP BY vec_id
        ), l AS (
            SELECT a, count(*) AS n FROM p GROUP BY a
        )
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM v JOIN c USING (vec_id) LEFT JOIN l ON l.a = v.vec_id
    """,
}
