"""helixframe: paired-genome differencing and edit auditing as lazy Spark DataFrame operations."""
