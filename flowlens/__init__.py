"""flowlens: network-flow analytics as Spark jobs."""
