"""Training-data operators: scoring, near-duplicates, filters, decontamination and mixing."""
