"""Relational layer: operators over generic tables of sequences, references, nodes, findings and events."""
