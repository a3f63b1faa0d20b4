"""Operators for building training data: decontamination, near-duplicates,
archives, token counts, language-model filters, mixing and sharding.  Nothing
outside this subpackage imports it."""
