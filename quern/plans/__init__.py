"""Plans: star schema, lineage, alerts and the whole run."""
