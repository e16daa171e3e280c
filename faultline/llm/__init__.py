"""Training-data operators: scoring, filtering, deduplication, decontamination, redaction, archives and packing."""
