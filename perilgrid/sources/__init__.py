"""Sources: CSV files, forecasts, images, settings, and frozen intermediate tables."""
