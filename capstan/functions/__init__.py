"""Row-wise Column expressions (no Python per row)."""
