"""tidewrack: operational-knowledge analytics over workplace messages, as Spark jobs."""
