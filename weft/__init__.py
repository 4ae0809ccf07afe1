"""weft: graph analytics and training-data operators as plain Spark plans."""
