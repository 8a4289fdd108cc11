"""Training-data operators: de-duplication, language, chat, search, shards, mixing, tokens, scoring, PII."""
