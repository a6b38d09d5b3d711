"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from leafmill.llm import boilerplate, encoding, frequency, leakage, lookalike, markup, repetition, sentences, tokenizer

QUERIES = {
    "p1_found": lookalike.p1_found,
    "p1_spellings": lookalike.p1_spellings,
    "p1_consistent": lookalike.p1_consistent,
    "p2_found": sentences.p2_found,
    "p3_found": boilerplate.p3_found,
    "p5_found": markup.p5_found,
    "p6_found": encoding.p6_found,
    "p7_found": frequency.p7_found,
    "p7_frequency": frequency.p7_frequency,
    "p8_ids": tokenizer.p8_ids,
    "p8_roundtrip": tokenizer.p8_roundtrip,
    "p9_found": leakage.p9_found,
    "p10_found": repetition.p10_found,
    "p10_shares": repetition.p10_shares,
}

_POSTINGS = """
    SELECT DISTINCT p.kind, p.term, p.seg, p.doc_id, p.sent_id
    FROM postings p
    WHERE p.kind IN ('word', 'gram') AND p.term <> ''
      AND p.seg IN (SELECT seg FROM segments WHERE fname LIKE '%.cdb')
"""

SQL = {
    "p7_frequency": f"""
        SELECT term, count(*) AS occurrences, count(DISTINCT (seg, doc_id)) AS records
        FROM ({_POSTINGS}) GROUP BY term""",
    "p7_found": f"""
        WITH f AS (SELECT term, count(DISTINCT (seg, doc_id)) AS n FROM ({_POSTINGS}) GROUP BY term),
             d AS (SELECT count(DISTINCT (seg, doc_id)) AS n FROM docinfo
                   WHERE seg IN (SELECT seg FROM segments WHERE fname LIKE '%.cdb'))
        SELECT f.term AS term, CASE WHEN f.n = 1 THEN 'rare' ELSE 'common' END AS mark
        FROM f, d WHERE f.n = 1 OR f.n * 5 > d.n""",
    "p8_roundtrip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
