"""Lead-intelligence analytics and training-data preparation on Spark."""
