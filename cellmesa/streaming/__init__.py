"""Running statistics over streams."""
