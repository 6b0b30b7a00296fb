"""SQL functions, and the queries of the reference's operators with their SQL."""
