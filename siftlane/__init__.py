"""Fragment-origin analytics on Spark: scores, classification, evaluation, sources and sinks."""
