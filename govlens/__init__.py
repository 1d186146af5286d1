"""govlens: governance analytics for hosted language models, on Spark."""
