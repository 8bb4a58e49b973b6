"""Schemas of the seeds and the landed tables."""

AUTHORS = "work_id string, title string, author string, tradition string, era string, is_self boolean, path string"
METRICS = (
    "metric_name string, display_name string, category string, unit string, higher_means string, "
    "description string, formula string, is_multivalue boolean, additivity string"
)

RAW_WORKS = "work_id string, word_count bigint, loaded_at timestamp_ntz"
RAW_MEASUREMENTS = "work_id string, metric string, value double, loaded_at timestamp_ntz"
RAW_VOCAB = "work_id string, term string, term_count bigint, loaded_at timestamp_ntz"
RAW = {"raw_works": RAW_WORKS, "raw_measurements": RAW_MEASUREMENTS, "raw_vocab": RAW_VOCAB}
