"""Column functions: guarded division, finite tests, strict rolling statistics, ranks."""
