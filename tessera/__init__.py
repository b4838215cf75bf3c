"""tessera: retrieval analytics over document collections, as Spark plans."""
