"""clausegrid: structural comparison of versioned documents on Spark."""
