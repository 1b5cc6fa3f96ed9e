"""fewstep: which known items become a target item with the fewest changes, planned on Spark."""
