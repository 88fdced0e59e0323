"""Column functions: rounding, guards, calendar, text classification, identifiers."""
