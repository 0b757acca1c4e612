"""Document-conversion fidelity analytics as Spark jobs."""
