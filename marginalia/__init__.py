"""Analysis of API documentation on Apache Spark: parsing, linting, cross-references, coverage, change detection."""
