"""Pooled-haplotype analytics as Spark jobs."""
