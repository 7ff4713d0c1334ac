"""From expressions to Spark plans."""
