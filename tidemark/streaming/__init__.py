"""Incremental work: resumable scoring as an idempotent batch job. There is no unbounded stream."""
