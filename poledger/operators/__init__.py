"""Jobs over tables: page text, routing, ingestion, rules, scoring, service, preparation."""
