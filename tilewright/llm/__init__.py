"""Training-data pipeline operators: media, rules, scoring, mixing, dedup, tokens, packing, HTML, shards, quality."""
