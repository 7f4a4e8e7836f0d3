"""evidrel: evidence retrieval and relational text analytics on PySpark."""
