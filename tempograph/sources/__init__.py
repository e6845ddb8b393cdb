"""Sources and sinks: files, the event graph, and result stores."""
