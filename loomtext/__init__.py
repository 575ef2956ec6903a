"""loomtext: parallel-text analytics expressed as Spark DataFrame and SQL plans."""
