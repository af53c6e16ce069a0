"""Training-data operators: archives, secrets, packing, decontamination, quality rules,
near duplicates, toxicity, quality scores, exact repeats, personal data, spelling variants,
ranked search and SentencePiece ids."""
