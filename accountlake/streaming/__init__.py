"""Change events: the same operators over streams."""
