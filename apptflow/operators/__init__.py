"""Table operators: scans, metrics, sampling, features, models, booking."""
