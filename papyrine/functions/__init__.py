"""functions of the papyrine engine."""
