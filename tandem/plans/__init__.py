"""Named plans: the six networks and the query catalogue."""
