"""operators of the forecast-verification engine."""
