"""The operators' queries, by the names the driver runs, and their SQL where SQL can express them."""

from __future__ import annotations

from lurescan.llm import (
    bpe,
    byte_cnn,
    collocations,
    conversations,
    exact_dedup,
    minhash,
    mixing,
    pseudonyms,
    quality_rules,
    sentence_pieces,
    substrings,
    token_counts,
    token_files,
)

QUERIES = {
    "op1_exact_dedup": exact_dedup.query,
    "op2_quality_rules": quality_rules.query,
    "op3_pseudonyms": pseudonyms.query,
    "op4_mixing": mixing.query,
    "op5_byte_bpe": bpe.query,
    "op6_token_counts": token_counts.query,
    "op7_token_files": token_files.query,
    "op8_byte_cnn": byte_cnn.query,
    "op9_substrings": substrings.query,
    "op10_minhash": minhash.query,
    "op11_sentence_pieces": sentence_pieces.query,
    "op12_conversations": conversations.query,
    "op13_collocations": collocations.query,
}

ORACLE = {
    "op1_exact_dedup": """
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents),
        g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)""",
    "op2_quality_rules": quality_rules.SQL,
    "op4_mixing": mixing.SQL,
    "op10_minhash": minhash.SQL,
    "op12_conversations": conversations.SQL,
    "op13_collocations": collocations.SQL,
}
