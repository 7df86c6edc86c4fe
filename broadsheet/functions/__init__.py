"""Column functions: vectors, keyword predicates, text cleaning, dates, name similarity."""
