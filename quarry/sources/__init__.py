"""Sources and sinks: driver tables, stand-in views, CSV/table IO, catalog introspection."""
