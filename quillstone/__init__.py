"""Data-quality and data-preparation engine on PySpark."""
