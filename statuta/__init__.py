"""Statuta: analytics over collections of regulatory documents, as Spark DataFrame jobs."""
