"""Training-data operators: deduplication, tokens, personal data, search, language models, quality, mixing."""
