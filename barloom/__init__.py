"""barloom: market-data research jobs on PySpark."""
