"""Column builders: text, rounding, grid cells, scores, vectors. No DataFrame is touched here."""
