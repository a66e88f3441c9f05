"""Panel analytics, tail-risk forecasting and forecast evaluation on Spark DataFrames."""
