"""Training-data operators: dedup, extraction, decontamination, quality, mixing, audit."""
