"""Audit-log and corpus analytics as Spark jobs."""
