"""tidemark: staging, activity marts and table profiling as Spark DataFrame jobs."""
