"""millrace: codec-style analytics and corpus processing as Spark DataFrame functions."""
