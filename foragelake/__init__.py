"""Set-oriented web-research analytics on PySpark."""
