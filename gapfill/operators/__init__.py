"""Table operators: injection, encoders, imputers, metrics."""
