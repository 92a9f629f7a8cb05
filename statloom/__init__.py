"""statloom: applied statistics as ordinary Spark DataFrame plans."""
