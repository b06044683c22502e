"""quillnet: knowledge-graph compilation and retrieval as Spark DataFrame plans."""
