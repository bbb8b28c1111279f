"""Sources and sinks: trace files, their adapters, and content-addressed records."""
