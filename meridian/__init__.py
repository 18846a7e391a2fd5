"""Public-influence analytics on Spark: record filters, entity links, per-cycle rollups, rankings and feeds, as DataFrame transformations."""
