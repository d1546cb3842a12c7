"""Event-time aggregates that run over tables and streams alike."""
