"""From configuration to tables and results: session, type normalisation, sinks."""
