"""Whole plans: extraction answers to verdicts, run scoring, run comparison."""
