"""Column-level helpers: period labels, date spans, text cleaning."""
