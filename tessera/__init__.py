"""tessera: messy documents in, consistent and traceable tables out, on Spark."""
