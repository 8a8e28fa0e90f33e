"""operators of the papyrine engine."""
