"""A Spark-first analytics engine for candle series, their contexts and the corpora built on them."""
