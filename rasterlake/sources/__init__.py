"""Tables, scans, decoders, JSON reads and sinks."""
