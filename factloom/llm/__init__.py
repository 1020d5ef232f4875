"""Training-data operators: quality, personal data, extraction, mixing, language, tokens, models and duplicates."""
