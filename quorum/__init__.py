"""quorum: statistically careful evaluation of judged systems, as Spark jobs."""
