"""quern: relational statements, change-log sources and keyed state as plain Spark jobs."""
