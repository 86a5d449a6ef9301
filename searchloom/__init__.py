"""Full-text document search and indexing on Spark."""
