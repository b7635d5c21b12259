"""Decision-point analytics on Spark: event logs in, audited decisions out."""
