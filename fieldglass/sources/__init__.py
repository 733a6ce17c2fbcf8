"""Sources and sinks: scan documents, host lists, lifecycle records; sheets as files."""
