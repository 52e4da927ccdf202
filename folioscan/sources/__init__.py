"""Sources and sinks: report XML, binary image headers, frames, dictionaries and versioned index tables."""
