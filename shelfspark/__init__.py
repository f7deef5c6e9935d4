"""shelfspark: turn tables of fetched web pages into a validated product catalog on Spark."""
