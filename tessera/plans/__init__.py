"""Query plans composed of operators, and the registry the driver reads."""
