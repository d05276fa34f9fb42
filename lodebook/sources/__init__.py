"""Sources: file trees, git history, parquet tables."""
