"""End-to-end jobs and the query registry exposed through ``__spark_entry__``."""
