"""quillgraph: knowledge-graph retrieval analytics as Spark DataFrame jobs."""
