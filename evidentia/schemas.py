"""Table schemas, as Spark DDL."""

from __future__ import annotations

#: One line per table of a corpus.
TABLES = {
    "documents": "document_id string, sha256 string, stored_path string, source_path string, filename string, byte_size bigint, page_count int, title string, authors array<string>, publication_year int, journal string, volume string, issue string, page_range string, doi string, abstract string, citation_key string, raw_metadata map<string,string>, added_at timestamp, updated_at timestamp, version bigint",
    "sources": "sha256 string, stored_path string, content binary",
    "pages": "document_id string, page_index bigint, page_number bigint, width double, height double, rotation int, extraction_status string, extraction_method string, extracted_text string, character_count bigint, word_count bigint, block_count bigint",
    "sentences": "document_id string, page_index bigint, logical_block_index bigint, primary_block_no bigint, block_sentence_index bigint, page_sentence_index bigint, document_sentence_index bigint, display_id string, source_text string, normalized_text string, character_count bigint, source_word_count bigint",
    "sentence_boxes": "display_id string, box_index bigint, block_no bigint, line_no bigint, x0 double, y0 double, x1 double, y1 double",
    "passages": "display_id string, document_id string, page_index bigint, logical_block_index bigint, block_passage_index bigint, sentence_ids array<string>, source_text string, normalized_text string, word_count bigint, sentence_count bigint, retrieval_eligible boolean, idx bigint, content_type string",
    "passage_sentences": "passage string, sentence string, position bigint",
    "ingestion_errors": "source_path string, filename string, error_type string, error_message string, created_at timestamp",
    "verification_runs": "run_id string, claim_id bigint, claim string, embedding_model string, reranker_model string, verifier_model string, configuration string, status string, warning string, error_message string, at timestamp",
    "verification_candidates": "run_id string, passage_id string, dense_rank bigint, dense_score double, bm25_rank bigint, bm25_score double, fusion_rank bigint, fusion_score double, rerank_rank bigint, rerank_score double, rerank_logit double, verifier_label string, verifier_reason string, verifier_raw_output string, verifier_parse_success boolean",
    "verification_evidence": "run_id string, passage_id string, sentence_id string, position bigint",
}
