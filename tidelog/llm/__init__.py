"""Training-data operators: licence scans, mixing, token files, quality, secrets, tokenising, chat, deduplication."""
