"""Document-concept analytics on Spark: tagging, assertions, code mapping, alignment, scoring."""
