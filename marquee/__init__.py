"""Programme analytics on Spark: schedule documents in, queryable tables out."""
