"""Sources and sinks: files, tables, pages and text documents."""
