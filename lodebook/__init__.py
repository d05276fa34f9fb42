"""lodebook: an index and search engine for source files and documents, on PySpark."""
