"""Sources, sinks and checkpoint handling."""
