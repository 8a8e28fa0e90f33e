"""sources of the papyrine engine."""
