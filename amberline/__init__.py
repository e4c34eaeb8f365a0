"""amberline: early-warning credit analytics written as Spark DataFrame jobs."""
