"""Rules on values: paths, patterns, validation, order."""
