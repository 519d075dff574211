"""Declared schemas (Spark DDL): nothing is ever inferred."""

RAW_ARTICLE = "id STRING, article STRING, highlights STRING"

TOKEN = "STRUCT<text STRING, normalized STRING, lemma STRING, pos STRING, tag STRING, is_stop BOOLEAN, is_punct BOOLEAN>"
ENTITY = "STRUCT<text STRING, label STRING, start_char INT, end_char INT>"
SENTENCE = (
    "STRUCT<sentence_index INT, original_text STRING, tokens ARRAY<STRING>, normalized_tokens ARRAY<STRING>, content_tokens ARRAY<STRING>, "
    f"lemmas ARRAY<STRING>, pos ARRAY<STRING>, tags ARRAY<STRING>, token_details ARRAY<{TOKEN}>, entities ARRAY<{ENTITY}>>"
)
ANNOTATED = f"id STRING, original_article STRING, cleaned_article STRING, original_sentences ARRAY<STRING>, processed_sentences ARRAY<{SENTENCE}>, highlights STRING"

SUMMARY = (
    "id STRING, article_id STRING, method STRING, num_sentences_requested INT, num_sentences_selected INT, summary STRING, "
    "selected_sentences ARRAY<STRUCT<sentence_index INT, score DOUBLE, original_text STRING, content_words ARRAY<STRING>>>, highlights STRING, "
    "top_terms ARRAY<STRUCT<term STRING, frequency INT, normalized_frequency DOUBLE, tfidf DOUBLE, tf DOUBLE, df INT, idf DOUBLE>>, "
    "ranking ARRAY<STRUCT<sentence_index INT, textrank_score DOUBLE>>, "
    "metadata STRUCT<number_of_sentences INT, damping_factor DOUBLE, max_iterations INT, tolerance DOUBLE, iterations INT, converged BOOLEAN, final_difference DOUBLE>"
)

ITEM = (
    "STRUCT<term STRING, normalized_form STRING, lemma STRING, pos STRING, frequency INT, sentence_frequency INT, sentence_indices ARRAY<INT>, "
    "entity_label STRING, importance_score DOUBLE, selection_reason STRING>"
)
VOCABULARY = (
    "article_id STRING, method STRING, configuration STRUCT<max_items INT, include_entities BOOLEAN, weights STRUCT<alpha_frequency DOUBLE, beta_coverage DOUBLE, gamma_entity DOUBLE>>, "
    f"total_candidate_items INT, returned_item_count INT, items ARRAY<{ITEM}>"
)
KNOWN_WORD = "term STRING, lemma STRING, entity_label STRING, source_kind STRING"
REFERENCE = "id STRING, article_id STRING, highlights STRING"

USERS = "id BIGINT, username STRING, password_hash STRING, created_at STRING"
HISTORY = (
    "id BIGINT, source_article_id STRING, title STRING, article_text STRING, summary STRING, method STRING, processing_timestamp STRING, "
    "extracted_vocabulary STRING, new_vocabulary STRING, metadata STRING, user_id BIGINT"
)
NOTES = "id BIGINT, term STRING, content STRING, example_sentence STRING, article_history_id BIGINT, created_at STRING, updated_at STRING, user_id BIGINT"
