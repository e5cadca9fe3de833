"""lexmill: statistical text analytics on the Spark DataFrame API."""
