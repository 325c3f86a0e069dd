"""Analytics of position-weighted strategies on Spark."""
