"""ibex."""
