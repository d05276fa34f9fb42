"""Query operators over the files, symbols, calls and commits tables."""
