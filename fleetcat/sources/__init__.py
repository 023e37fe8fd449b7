"""Sources and sinks: definition text, layout JSON, folder discovery, quarantine, catalog writer."""
