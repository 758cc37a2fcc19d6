"""Column functions: rankings, texts, scores, vectors."""
