"""plans of the forecast-verification engine."""
