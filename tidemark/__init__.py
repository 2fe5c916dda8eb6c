"""tidemark: event-stream and price analytics, and training-data operators, on Spark DataFrames."""
