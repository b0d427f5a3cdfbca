"""The queries of this subpackage and, where DuckDB can express them, their SQL."""

from __future__ import annotations

from spindrift.llm.bpe import op3_bpe
from spindrift.llm.line_dedup import op9_line_dedup
from spindrift.llm.lm_scoring import op4_lm_scoring
from spindrift.llm.mixing import op10_mixing
from spindrift.llm.nearest import op7_nearest
from spindrift.llm.ngram_join import op5_jaccard_join
from spindrift.llm.pii import op1_pii
from spindrift.llm.sharding import op6_sharding
from spindrift.llm.sketches import op2_fingerprints
from spindrift.llm.toxicity import op8_toxicity
from spindrift.llm.variants import op12_variants
from spindrift.llm.warc import op13_warc
from spindrift.llm.whitening import op11_whitening

QUERIES = {
    "op1_pii": op1_pii,
    "op2_fingerprints": op2_fingerprints,
    "op3_bpe": op3_bpe,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_sharding": op6_sharding,
    "op7_nearest": op7_nearest,
    "op8_toxicity": op8_toxicity,
    "op9_line_dedup": op9_line_dedup,
    "op10_mixing": op10_mixing,
    "op11_whitening": op11_whitening,
    "op12_variants": op12_variants,
    "op13_warc": op13_warc,
}

ORACLE_SQL: dict[str, str] = {
    "op4_lm_scoring": """
        WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS list FROM documents),
        words AS (SELECT doc_id, unnest(list) AS word, generate_subscripts(list, 1) AS pos FROM texts),
        pairs AS (SELECT doc_id, word, coalesce(lag(word) OVER (PARTITION BY doc_id ORDER BY pos), '') AS before FROM words),
        own1 AS (SELECT doc_id, word, count(*) AS n FROM words GROUP BY ALL UNION ALL SELECT DISTINCT doc_id, '', 1 FROM words),
        own2 AS (SELECT doc_id, before, word, count(*) AS n FROM pairs GROUP BY ALL),
        all1 AS (SELECT word, sum(n) AS n FROM own1 GROUP BY ALL), all2 AS (SELECT before, word, sum(n) AS n FROM own2 GROUP BY ALL),
        scored AS (SELECT p.doc_id, p.n, CASE WHEN b.n > p.n THEN ln((b.n - p.n) / (f.n - fo.n))
                ELSE ln(0.4 * greatest(s.n - so.n, 0.5) / (SELECT count(*) FROM words)) END AS score
            FROM own2 p JOIN all2 b USING (before, word) JOIN all1 f ON f.word = p.before JOIN own1 fo ON fo.doc_id = p.doc_id AND fo.word = p.before
            JOIN all1 s ON s.word = p.word JOIN own1 so ON so.doc_id = p.doc_id AND so.word = p.word)
        SELECT doc_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_words, round(sum(n * score) / sum(n), 6) AS score
        FROM documents LEFT JOIN scored USING (doc_id) GROUP BY doc_id""",
    "op9_line_dedup": """
        WITH texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        lines AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM texts),
        keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
        common AS (SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        marked AS (SELECT doc_id, line, pos, holder IS NOT NULL AND doc_id <> holder AS gone FROM keyed LEFT JOIN common USING (key))
        SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op13_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        d AS (SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p),
        h AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS holder FROM d)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND holder <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 1000 AND holder <> page_id THEN holder END AS refers_to FROM h""",
}
