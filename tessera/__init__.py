"""Panel analytics on Spark: a factor expression language and the tables around it."""
