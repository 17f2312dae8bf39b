"""driftlake: time-lapse registration and benchmark analytics on Spark DataFrames."""
