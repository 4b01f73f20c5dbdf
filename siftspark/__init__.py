"""PySpark engine for code-analysis findings and large-corpus text work."""
