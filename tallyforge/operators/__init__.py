"""Statistics, sampling and counting over foreign-key schemas."""
