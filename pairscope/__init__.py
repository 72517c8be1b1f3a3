"""pairscope: paired-evaluation analytics expressed as Spark DataFrame operators."""
