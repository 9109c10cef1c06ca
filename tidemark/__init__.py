"""tidemark: state-space decoding of event streams, expressed as Spark DataFrames."""
