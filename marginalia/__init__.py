"""marginalia: a Spark-first retrieval, curation and corpus-preparation engine."""
