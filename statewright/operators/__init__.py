"""Operators on two states of a table: diff, groups, references, lints, order, guarded application, audit."""
