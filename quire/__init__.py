"""quire: document-corpus preparation, retrieval and learning analytics as Spark jobs."""
