"""Analytics on Spark: operators from data frames to data frames, and the queries made of them."""
