"""plans of the papyrine engine."""
