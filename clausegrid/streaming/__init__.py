"""Job progress and trace events as streams."""
