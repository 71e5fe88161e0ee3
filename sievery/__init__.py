"""Record curation and corpus preparation as Spark jobs."""
