"""Whole plans: the stored archive, the semantic index, the engine's commands."""
