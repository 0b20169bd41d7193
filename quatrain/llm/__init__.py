"""Training-data operators: token counts, archives, deduplication, quality, decontamination, secrets, pages."""
