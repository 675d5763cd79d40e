"""Column functions: canonical spellings by type, checks on values, keys."""
