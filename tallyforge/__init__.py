"""Evidence-driven quantity takeoff and pricing on Spark DataFrames."""
