"""functions of the forecast-verification engine."""
