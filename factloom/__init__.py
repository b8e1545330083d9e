"""factloom: evidence retrieval, fact tables and data-set gates as PySpark jobs."""
