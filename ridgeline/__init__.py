"""Point-in-time factor research and market-event processing as PySpark jobs."""
