"""Tables of a block history, and how they are derived from or stored for queries."""
