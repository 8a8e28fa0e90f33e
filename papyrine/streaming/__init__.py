"""streaming of the papyrine engine."""
