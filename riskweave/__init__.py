"""Defect-risk ranking of source files across many repositories, as Spark DataFrame jobs."""
