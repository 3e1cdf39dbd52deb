"""reportloom: free-text clinical reports to structured, scored findings, on PySpark."""

__version__ = "0.1.0"
