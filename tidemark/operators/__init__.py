"""DataFrame to DataFrame operators: chunking, coding cost, probes, analyses, experiment ledger."""
