"""loresift: document-retrieval analytics and corpus processing as Spark plans."""
