"""growthlens: growth analytics over entities, interactions and time series, as Spark plans."""
