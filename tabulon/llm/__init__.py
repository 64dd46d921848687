"""Training-data operators: dedup, language ID, mixing, tokenising, chat formatting, nearest neighbours."""
