"""quern: a Spark-first engine for retail/weather analytics and large-scale batch data processing."""
