"""streaming of the forecast-verification engine."""
