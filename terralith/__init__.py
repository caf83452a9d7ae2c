"""Object-based image analytics on Spark: pixel relations in, segment features and classes out."""
