"""Query plans: the registry of Spark queries and their oracle SQL."""
