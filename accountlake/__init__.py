"""Account enrichment over tables and streams, written as Spark DataFrame operators."""
