"""Operators of a training-data pipeline: mixing, packing, deduplication, language
ID, HTML extraction, language-model scoring, personal data, WARC archives and
embedding near-duplicates. Nothing else in the library imports this subpackage."""
