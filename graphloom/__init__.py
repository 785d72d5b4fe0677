"""Code-graph analytics on Spark: extraction, incremental index, and graph queries as DataFrame plans."""
