"""Column functions: durations and clocks, event references, alert texts."""
