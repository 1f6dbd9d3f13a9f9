"""Scalar layer: text, numerals, markers, headings and citations as Column expressions."""
