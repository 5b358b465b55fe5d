"""Fleet sensor analytics on Spark: readings, thermal fits, comfort scores, decision reports and rules."""
