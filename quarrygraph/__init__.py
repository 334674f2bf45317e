"""Software-estate knowledge graphs on Spark: typed node and edge DataFrames and the questions asked of them."""
