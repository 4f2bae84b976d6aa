"""Entity linking and label-quality jobs on Spark."""
