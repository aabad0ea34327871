"""What-if analysis: overrides, shocks, formula columns and saved scenarios."""
