"""DataFrame operators: replay, islands, signals, decoding, and quality of labels."""
