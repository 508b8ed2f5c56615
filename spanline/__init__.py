"""spanline: PySpark operators for time-aligned turns, transcripts, embeddings and run telemetry."""
