"""Training-data operators: dedup, decontamination, scoring, packing, archives and redaction."""
