"""sources of the forecast-verification engine."""
