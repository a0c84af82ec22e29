"""quern: relational analytics, vector search and versioned tables on Spark."""
