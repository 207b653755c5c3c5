"""Road-network point analysis as Spark DataFrame jobs."""
