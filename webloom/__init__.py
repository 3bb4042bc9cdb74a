"""webloom — web-page extraction and crawl-data tables on PySpark."""

__version__ = "0.1.0"
