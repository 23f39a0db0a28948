"""latticework: layered block-residual analytics for regularly sampled signals, on Spark DataFrames."""
