"""flowlens: branch-level trading-flow analytics expressed as Spark DataFrame operators."""
