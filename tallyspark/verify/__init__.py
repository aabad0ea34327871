"""An independent row-at-a-time evaluator, and checks against it."""
