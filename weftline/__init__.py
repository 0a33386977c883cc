"""weftline: analytics over recorded web traffic, pages and documents, on Spark."""
