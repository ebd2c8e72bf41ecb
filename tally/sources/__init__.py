"""Sources and sinks: test-table views, CSV/JSON readers, ledger and exports."""
