"""Training-data operators: WARC, token counts, language ID, mixing, token files, sharding, fingerprints,
language-model scoring, benchmark decontamination and near-duplicate removal. Nothing else in the library imports this."""
