"""Network measures, summaries, features, models and plot data."""
