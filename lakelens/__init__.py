"""Analytics for document and media catalogs on Spark."""
