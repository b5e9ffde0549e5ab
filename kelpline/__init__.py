"""Catalogue search, entity resolution, enrichment and audit as Spark DataFrame jobs."""
