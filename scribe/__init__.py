"""scribe: cleaning, repairing and analysing noisy transcribed text on Spark."""
