"""Configuration, change sets, recorded state and the composite commands."""
