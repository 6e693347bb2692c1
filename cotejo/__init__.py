"""Record reconciliation and corpus preparation as Spark jobs."""
