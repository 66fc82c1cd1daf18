"""Model fits whose passes over the data are Spark jobs and whose k x k algebra is local."""
